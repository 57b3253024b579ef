"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words a batch has not met yet lie behind each other in one flat array of
symbols. Each round finds the best (least) rank of a neighbouring pair of every
word by a segmented minimum, merges all its places in the word at once, leftmost
first where they overlap, and compacts the array; words without a pair leave it.
Rounds end when no word has a pair. A word's merges stop early where one makes a
pair that would come before the next of them, so that results equal merging one
pair at a time. Runs of one symbol whose pieces all have one rank (the model's
runs of spaces) are cut into pieces in a single round.

Words end before a space mark that follows another character, and around
characters that no piece joins to others; no merge crosses these places, which
is read off the model. A character without a piece becomes its UTF-8 bytes. The
model file is a parameter; its tables go to executors as one broadcast, bounded
by the vocabulary. Models with another normaliser than the plain one, or with
user-defined pieces, are refused.

Null text is encoded like empty text: begin and end only. Repeated rows are
encoded each. Only the id and text columns are read, so other columns may have
any name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import map_rows, prepare, sha

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words remembered by a Python worker; beyond that the memory starts anew.
MEMO = 400_000
#: Characters of the longest word that is remembered, so that the memory is bounded in bytes.
KEEP = 64
#: Symbols of new words that are merged together.
FLAT = 1 << 20


def load_model(path: str) -> dict:
    """pieces (text, score), bytes (id by byte), bos, eos, unk of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  b ﬁ "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("only models with a space in front and no other normalisation are supported")
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(sp.is_unused(i) for i in plain):
        raise ValueError("unused pieces are not supported")
    raw = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(raw) != 256:
        raise ValueError("only models with byte fallback are supported")
    return {
        "size": n, "pieces": {i: (sp.id_to_piece(i), sp.get_score(i)) for i in plain}, "bytes": [raw[b] for b in range(256)],
        "bos": sp.bos_id(), "eos": sp.eos_id(), "unk": sp.unk_id(),
    }


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        self.model = model
        self._ready()

    def __getstate__(self) -> dict:
        return self.model

    def __setstate__(self, model: dict) -> None:
        self.model = model
        self._ready()

    def _ready(self) -> None:
        m, pieces = self.model, self.model["pieces"]
        ids = {t: i for i, (t, _) in pieces.items()}
        symbols = dict(ids)  # and characters that occur in pieces only
        for t in ids:
            for c in t:
                symbols.setdefault(c, m["size"] + len(symbols) - len(ids))
        self.other = m["size"] + len(symbols) - len(ids)  # any further character: it joins nothing
        self.base = self.other + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for t, i in symbols.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.rank = np.full(self.base, NONE, np.int32)
        for i, (_, s) in pieces.items():
            self.rank[i] = order[s]
        self.made_rank = np.append(self.rank, NONE)  # by what a pair makes; -1, the last entry, is nothing
        found = [(symbols[t[:k]] * self.base + symbols[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols]
        found.sort()
        self.pair_key = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], np.int64)
        self.pair_id = np.array([i for _, i in found] + [-1], np.int32)
        # Pieces that can join a neighbour to something that comes no later than they do themselves.
        self.risky = np.zeros(self.base, bool)
        left, right, made = self.pair_key[:-1] // self.base, self.pair_key[:-1] % self.base, self.rank[self.pair_id[:-1]]
        self.risky[left[made <= self.rank[left]]] = True
        self.risky[right[made <= self.rank[right]]] = True
        self._runs(ids, symbols)
        joined = {c for t in ids if len(t) > 1 for c in t}
        lone = "".join(c for c in map(chr, range(128)) if c not in joined)
        inner = any(MARK in t.lstrip(MARK) for t in ids)  # pieces that go on beyond a space: then a text is one word
        edge = "" if inner else MARK
        lone_class = f"|[{re.escape(lone)}]" if lone else ""
        body = f"[^{edge}{re.escape(lone)}]+" if edge or lone else "(?s:.)+"
        self.split = re.compile((f"{MARK}*{body}|{MARK}+" if edge else body) + lone_class).findall
        tokens = [b""] * m["size"]
        for i, (t, _) in pieces.items():
            tokens[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(m["bytes"]):
            tokens[i] = bytes([b])
        tokens[m["unk"]] = " ⁇ ".encode()
        self.tokens = tokens
        self.memo: dict[str, list[int]] = {}

    def _runs(self, ids: dict[str, int], symbols: dict[str, int]) -> None:
        """The rank that pieces of one repeated character share, if it is theirs alone and no other piece holds the character twice in a row.

        ``run_heads[n, i]``: does a piece begin at ``i`` in a run of ``n``, up to the
        longest piece? Longer runs are cut into longest pieces first, if merging
        one pair at a time does the same.
        """
        by_rank: dict[int, list[str]] = {}
        for t, i in ids.items():
            if len(t) > 1:  # what merges make
                by_rank.setdefault(int(self.rank[i]), []).append(t)
        self.run_rank, self.run_symbol, self.run_ids = -1, -1, None
        for r, ts in by_rank.items():
            c, k = ts[0][0], max(map(len, ts))
            if len(ts) < 2 or any(set(t) != {c} for t in ts) or sum(c + c in t for t in ids) != len(ts):
                continue
            cuts = [_leftmost(n, {len(t) for t in ts}) for n in range(4 * k + 1)]
            if any(cuts[n] != [k, *cuts[n - k]] for n in range(k, 4 * k + 1)):
                continue
            self.run_rank, self.run_symbol = r, symbols[c]
            self.run_ids = np.array([symbols.get(c * n, -1) for n in range(k + 1)], np.int32)
            self.run_heads = np.zeros((k + 1, k), bool)
            for n in range(1, k + 1):
                self.run_heads[n, np.cumsum([0, *cuts[n][:-1]])] = True
            return

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, or -1."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_id[at], np.int32(-1))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word after all merge rounds."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word, at_point = self.of_char[points], np.repeat(np.arange(len(words)), sizes), np.arange(len(points))
        done = []
        made = np.full(len(sym), -1, np.int32)  # what a symbol makes with the next one of its word
        if len(sym) > 1:
            made[:-1] = np.where(word[1:] == word[:-1], self._pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = self.made_rank[made]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best != NONE
            lengths = np.diff(np.r_[starts, len(sym)])
            if not live.all():  # words without a pair leave
                keep = np.repeat(live, lengths)
                done.append((word[~keep], sym[~keep], at_point[~keep]))
                sym, word, made, rank, at_point = sym[keep], word[keep], made[keep], rank[keep], at_point[keep]
                best, lengths = best[live], lengths[live]
                if not len(sym):
                    break
            if self.run_ids is not None and (run := best == self.run_rank).any():
                sym, word, made, at_point = self._cut_runs(sym, word, made, at_point, np.repeat(run, lengths))
                continue
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            # Of places that overlap, every second one from the left.
            near = np.diff(at) == 1
            if near.any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(np.r_[True, ~near], place, 0))) % 2 == 0]
            if self.risky[made[at]].any():
                at = self._until_earlier(sym, word, made, rank, at)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the second symbols are gone
            sym, word, made, at_point = sym[keep], word[keep], made[keep], at_point[keep]
            before = at[at > 0] - 1
            self._renew(sym, word, made, np.concatenate([at, before]))
        return self._lists(points, len(words), *map(np.concatenate, zip(*done)))

    def _lists(self, points: np.ndarray, n: int, word: np.ndarray, sym: np.ndarray, at_point: np.ndarray) -> list[list[int]]:
        """The symbols of ``n`` words as lists of ids; symbols that are no pieces are single characters and become bytes."""
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        ends = np.searchsorted(word, np.arange(n + 1)).tolist()
        ids = sym.tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        odd = np.flatnonzero(sym >= self.model["size"])
        if len(odd):
            raw, at_point = self.model["bytes"], at_point[order]
            for w in np.unique(word[odd]).tolist():
                a, b = ends[w], ends[w + 1]
                out[w] = [x for k in range(a, b) for x in ([ids[k]] if ids[k] < self.model["size"] else [raw[c] for c in chr(points[at_point[k]]).encode("utf-8", "surrogatepass")])]
        return out

    def _renew(self, sym, word, made, at) -> None:
        """What the symbols at ``at`` make with their new neighbours."""
        last = at == len(sym) - 1
        nxt = np.where(last, at, at + 1)
        made[at] = np.where(~last & (word[at] == word[nxt]), self._pairs(sym[at], sym[nxt]), -1)

    def _until_earlier(self, sym, word, made, rank, at) -> np.ndarray:
        """The places up to the first of each word whose merge makes a pair that comes before the next place."""
        n, new, r = len(sym), made[at], rank[at]
        before = np.r_[False, (np.diff(at) == 2) & (word[at[1:]] == word[at[:-1]])]  # the merge just left of this one
        left = np.where(before, np.r_[np.int32(0), new[:-1]], sym[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        right, has_right = sym[np.minimum(at + 2, n - 1)], (at + 2 < n) & (word[np.minimum(at + 2, n - 1)] == word[at])
        early = has_left & (self.made_rank[self._pairs(left, new)] <= r) | has_right & (self.made_rank[self._pairs(new, right)] <= r)
        seen = np.cumsum(early) - early  # early merges before this one, over all words
        w = word[at]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        return at[seen == np.repeat(seen[first], np.diff(np.r_[first, len(at)]))]

    def _cut_runs(self, sym, word, made, at_point, mine):
        """The runs of the run symbol in the words ``mine``, each cut into pieces."""
        k = len(self.run_ids) - 1
        hit = mine & (sym == self.run_symbol)
        start = hit & ~(np.r_[False, hit[:-1]] & np.r_[False, word[1:] == word[:-1]])
        run = np.where(hit, np.cumsum(start), 0)
        first, length = np.r_[0, np.flatnonzero(start)][run], np.bincount(run)[run]
        offset = np.arange(len(sym)) - first
        head = hit.copy()
        head[hit] = self.run_heads[np.minimum(length - offset // k * k, k)[hit], (offset % k)[hit]]
        keep = ~hit | head
        size = np.bincount(np.cumsum(keep) - 1)
        sym, word, made, at_point, heads = sym[keep], word[keep], made[keep], at_point[keep], head[keep]
        sym = np.where(heads, self.run_ids[np.where(heads, size, 1)], sym)
        self._renew(sym, word, made, np.flatnonzero(heads | np.r_[heads[1:], False]))
        return sym, word, made, at_point

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, begin and end included. New words are merged together, in blocks of FLAT symbols."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = set().union(*split).difference(memo)
        block, held = [], 0
        for w in new:
            block.append(w)
            held += len(w)
            if held >= FLAT:
                memo.update(zip(block, self.merge(block)))
                block, held = [], 0
        memo.update(zip(block, self.merge(block)))
        bos, eos = [self.model["bos"]], [self.model["eos"]]
        out = [[*bos, *chain.from_iterable(map(memo.__getitem__, ws)), *eos] for ws in split]
        for w in new:
            if len(w) > KEEP:
                del memo[w]
        return out

    def decode(self, ids) -> str:
        """The text of ids: marks are spaces, one in front is dropped, bytes that are no UTF-8 become U+FFFD each."""
        ids, control = list(ids), (self.model["bos"], self.model["eos"])
        parts = list(map(self.tokens.__getitem__, ids))
        lead = next((k for k, i in enumerate(ids) if i not in control), None)
        if lead is not None and ids[lead] in self.model["pieces"] and parts[lead].startswith(b" "):
            parts[lead] = parts[lead][1:]
        try:
            if sum(map(ids.count, set(control))) == sum(i in control for i in ids[:1] + ids[1:][-1:]):
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            return _lossy(b"".join(parts))
        inside = [k for k, i in enumerate(ids) if i in control and 0 < k < len(ids) - 1]
        # Bytes on the two sides of a begin or end id are no one character.
        return "".join(_lossy(b"".join(parts[a:b])) for a, b in zip([0, *inside], [*inside, len(ids)]))


def _leftmost(n: int, sizes: set[int]) -> list[int]:
    """Sizes of the pieces of a run of ``n`` equal characters, if the leftmost pair that makes one of ``sizes`` always goes first."""
    out = [1] * n
    while (i := next((i for i in range(len(out) - 1) if out[i] + out[i + 1] in sizes), None)) is not None:
        out[i : i + 2] = [out[i] + out[i + 1]]
    return out


def _lossy(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _shared(df: DataFrame, path: str):
    """A broadcast codec. Its size is bounded by the model file."""
    prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(PieceCodec(load_model(path)))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int, begin and end included) of every row."""
    codec = _shared(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, lambda: lambda b: {"doc_id": b.column(0), "ids": codec.value.encode_all(b.column(1).to_pylist())}, schema, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``text`` of every row of ids; null ids give an empty text."""
    codec = _shared(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_rows(picked, lambda: lambda b: {"doc_id": b.column(0), "text": [codec.value.decode(x or []) for x in b.column(1).to_pylist()]}, schema, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, same (decoded is the text)."""
    codec = _shared(df, path)

    def start():
        c = codec.value

        def step(b: pa.RecordBatch) -> dict:
            texts = b.column(1).to_pylist()
            n, ids_sha, out_sha, same = [], [], [], []
            for text, ids in zip(texts, c.encode_all(texts)):
                back = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(np.array(ids, "<u4").tobytes()))
                out_sha.append(sha(back.encode()))
                same.append(back == (text or ""))
            return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": out_sha, "same": same}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, start, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")

"""Token counts of a unigram model by dynamic programming shared along a trie.

The distinct pre-tokens of a batch are inserted in a trie. A node's forward
score, the best sum of log-probabilities of a segmentation of the prefix it
spells, and the number of pieces of that segmentation are computed once,
however many pre-tokens share the prefix; a pre-token's terminal keeps the
count. A text's count is the sum over its pre-tokens.

Vocabulary: that of a sentencepiece model file (a parameter, never trained
here); a piece of rank r has log-probability ``-log(r + 1)`` up to a constant
share per piece, which is Zipf's law for a vocabulary ordered by frequency. A
character in no piece costs ``UNKNOWN`` and counts as its UTF-8 bytes. Ties go
to fewer pieces. Pre-tokens are runs of non-space characters with a leading
word mark.

Null and empty texts count 0. Repeated rows are counted each; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import map_rows, prepare

MARK = "▁"
UNKNOWN = -30.0
WORDS = re.compile(r"\S+")
#: Pre-tokens remembered by a Python worker; beyond that the memory starts anew.
MEMO = 400_000
#: Characters of the longest pre-token that is remembered, so that the memory is bounded in bytes.
KEEP = 64


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability from the rank of the ordinary pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    h = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(r + 1) - h for r, i in enumerate(ids)}


class Unigram:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)

    def counts(self, tokens) -> dict[str, int]:
        """Pieces of the best segmentation of each distinct token, by a depth-first walk of their trie.

        Sorted tokens visit the trie in depth-first order; the path to the
        current node is the only part that has to be held.
        """
        get, longest = self.pieces.get, self.longest
        score, count = [0.0], [0]  # along the path
        last, out = "", {}
        for t in sorted(set(tokens)):
            same = 0
            for a, b in zip(last, t):
                if a != b:
                    break
                same += 1
            del score[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(t) + 1):
                best = score[end - 1] + UNKNOWN
                few = count[end - 1] + len(t[end - 1].encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - longest), end):
                    p = get(t[start:end])
                    if p is not None:
                        s, c = score[start] + p, count[start] + 1
                        if s > best or s == best and c < few:
                            best, few = s, c
                score.append(best)
                count.append(few)
            out[t] = count[len(t)]
            last = t
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Unigram(load_pieces(path)))  # bounded by the vocabulary file

    def start():
        m = model.value
        memo: dict[str, int] = {}

        def step(b: pa.RecordBatch) -> dict:
            split = [WORDS.findall(x) if x else [] for x in b.column(1).to_pylist()]
            new = {w for ws in split for w in ws}.difference(memo)
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = {w for ws in split for w in ws}
            made = {w[1:]: n for w, n in m.counts(MARK + w for w in new).items()}
            memo.update((w, n) for w, n in made.items() if len(w) <= KEEP)
            long = {w: n for w, n in made.items() if len(w) > KEEP}
            count = lambda w: memo[w] if w in memo else long[w]
            return {"doc_id": b.column(0), "n_pretokens": list(map(len, split)), "n_tokens": [sum(map(count, ws)) for ws in split]}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, schema, "doc_id long, n_pretokens long, n_tokens long")

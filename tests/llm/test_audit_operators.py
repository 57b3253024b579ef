"""Filter interaction audit, SentencePiece BPE and source divergence against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from concordat.llm import filter_audit, piece_bpe, queries, source_divergence

HARD = [None, "", " ", "a", "é漢字🎉 a b", "x" * 20000, "1 " * 5000, "the same text here again", "the same text here again", "\n\t\r", " " * 31 + "tail", "漢" + " " * 47]


# SentencePiece


@pytest.fixture(scope="module")
def model():
    path = queries.vocabulary(queries.PIECE_FILE)
    return piece_bpe.PieceCodec(piece_bpe.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(model):
    ours, lib = model
    rnd = random.Random(5)
    kinds = ["ab ▁ehlostn\n tion漢é", "  \t▁x", "".join(map(chr, range(1, 128))), "абвгд еёж", "漢字かなカナ 。"]
    texts = HARD[1:] + ["".join(rnd.choice(k) for _ in range(rnd.randint(0, 120))) for k in kinds for _ in range(400)]
    texts += [" " * n + t for n in range(40) for t in ("", "x", "漢", "\n")]
    for i in range(0, len(texts), 97):
        some = texts[i : i + 97]
        got = ours.encode_all(some)
        assert got == [lib.encode(t, add_bos=True, add_eos=True) for t in some]
        assert [ours.decode(x) for x in got] == [lib.decode(x) for x in got]


def test_any_ids_decode_as_the_library_does(model):
    ours, lib = model
    rnd = random.Random(6)
    for _ in range(5000):
        ids = [rnd.randint(0, 31999) if rnd.random() < 0.5 else rnd.randint(0, 260) for _ in range(rnd.randint(0, 10))]
        assert ours.decode(ids) == lib.decode(ids)


def test_merges_stop_where_an_earlier_pair_appears():
    """A made-up model in which a merge makes a pair that comes before the other places of its own pair."""
    pieces = ["ab", "cab", "ba", "aba", "abab", "cc", "aa", "aaa"]
    rnd = random.Random(7)
    for _ in range(40):
        scores = {p: -float(rnd.randint(0, 4)) for p in pieces}
        codec = piece_bpe.PieceCodec({
            "size": 300, "pieces": {259 + i: (p, scores.get(p, -99.0)) for i, p in enumerate(["a", "b", "c", "▁", *pieces])},
            "bytes": list(range(3, 259)), "bos": 1, "eos": 2, "unk": 0,
        })
        for _ in range(40):
            word = "".join(rnd.choice("aabbc") for _ in range(rnd.randint(1, 12)))
            parts = ["▁", *word]
            while found := [(-scores[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in scores]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = codec.encode_all([word])[0][1:-1]
            assert [codec.model["pieces"][i][0] for i in got] == parts, (word, scores)


def test_long_words_take_linear_rounds(model):
    ours, lib = model
    rnd = random.Random(8)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(500_000))
    t = time.time()
    for text in (word, " " * 500_000, "a" * 500_000):
        assert ours.encode_all([text])[0] == lib.encode(text, add_bos=True, add_eos=True)
    assert time.time() - t < 30


def test_pieces_in_spark(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(10**6 + i, t, "clash") for i, t in enumerate(HARD)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    both = docs.unionByName(hard, allowMissingColumns=True)
    path, lib = queries.vocabulary(queries.PIECE_FILE), model[1]
    want = {}
    for r in both.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = piece_bpe.round_trip(both, path).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert piece_bpe.round_trip(both.limit(0), path).count() == 0
    back = {r.doc_id: r.text for r in piece_bpe.decode(piece_bpe.encode(hard, path), path).collect()}
    assert back == {r.doc_id: lib.decode(lib.encode(r.text or "")) for r in hard.collect()}


# Filter audit


def audit_of(docs, labels):
    """The audit by walking every order over every row."""
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {c for c, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t))) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            f.add("E")
        fails.append((part or "", f, i))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(f, i) for p, f, i in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in f for f, _ in mine) - len(gone), sum(f == {c} for f, _ in mine), sum(good[i] for _, i in gone if i is not None), sum(toxic[i] for _, i in gone if i is not None)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("slice_rows", [10**6, 25])
def test_audit_equals_walking_every_order(spark, slice_rows):
    rnd = random.Random(9)
    pool = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "DELTA", "x#", "100%", "漢字"]) + str(rnd.randint(0, k)) for _ in range(rnd.randint(1, 90))) for k in (1, 5, 10**6) for _ in range(10)]
    docs = [(i, rnd.choice(pool), rnd.choice(["s1", "s2", None])) for i in range(120)]
    docs += [(200 + i, t, "hard") for i, t in enumerate(HARD)] + [(5, pool[0], "s1"), (5, pool[1], "s1"), (5, pool[1], "s1"), (None, pool[0], "s2"), (None, None, None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("h", "g", "part", "mask", "first", "slice", "good")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(d, lab, slice_rows=slice_rows).collect()}
    assert got == audit_of(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert filter_audit.audit(d, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_sketch_clears_only_unique_texts(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 10 == 0, F.lit(0)).otherwise(F.col("id"))).alias("text"), F.lit("s").alias("source"))
    rows = filter_audit.flagged(d)
    bits = filter_audit.repeat_bits(rows, filter_audit.sketch_size(20000))
    maybe = {r.doc_id for r in rows.where(filter_audit.may_repeat(spark, bits)).collect()}
    assert {i for i in range(20000) if i % 10 == 0} <= maybe and len(maybe) < 3500


# Source divergence


def divergence_of(docs, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, counts = Counter(), {}
    for lang, source, text in docs:
        lang, source, found = lang or "", source or "", terms(text)
        df.update((lang, t) for t in set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = price(own), price(whole)
        pairs = [(-sum(abs(p[t] - o[t]) for t in kept), s.encode()) for s, o in ((s, price(c)) for s, c in groups.items() if s != source)]
        tell = [(q[t] - p[t], t.encode()) for t in kept if own[t] and p[t] > q[t]]
        out |= {(lang, source, "pair", s.decode(), -v, k) for k, (v, s) in enumerate(sorted(pairs), 1)}
        out |= {(lang, source, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(tell)[:top], 1)}
    return out


def divergence_docs():
    rnd = random.Random(10)
    words = [a + b for a in ("", "ab", "É", "漢", "zz", "Q") for b in "abcdefgh"]
    docs = [(rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "é", None, "s9"]), " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30)))) for _ in range(150)]
    return docs + [("xx", s, t) for s in ("s1", "s2", "s3") for t in (None, "", "12 34", "rare")] + [("en", "bare", None), ("one", "only", "x y z"), ("en", "hard", "a " * 5000)] + [("en", "s1", t) for t in HARD]


@pytest.mark.parametrize("block,side,held", [(1 << 12, 64, 200_000), (3, 2, 20)])
def test_divergence_equals_plain_counting(spark, monkeypatch, block, side, held):
    monkeypatch.setattr(source_divergence, "SIDE", side)
    monkeypatch.setattr(source_divergence, "HELD", held)
    docs = divergence_docs()
    d = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "id", "block", "value", "rank", "other")})
    got = source_divergence.divergence(d, min_docs=4, top=7, block=block).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == divergence_of(docs, 4, 7)
    assert source_divergence.divergence(d.limit(0)).count() == 0


def test_prices_of_large_counts():
    big = np.array([0, 1, 10**12, 3 * 10**15], np.int64)
    total, terms = 8 * 10**15, 10**7
    assert source_divergence.prices(big, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in big]

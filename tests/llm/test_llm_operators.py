import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from concordat.llm import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, license_scan, pii, queries, token_counts, toxicity

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HARD = [None, "", " ", "a", "é漢字🎉 a b", "x" * 20000, "1 " * 5000, "the same text here again", "the same text here again", "\n\t\r"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and long texts, repeats, columns with clashing names."""
    rows = [(i, t, "en", i) for i, t in enumerate(HARD)] + [(7, HARD[7], None, 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int").withColumns({c: F.lit("clash") for c in ("score", "id", "words", "n_words", "token", "fp", "base", "rid", "keep_id", "h")})


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, same):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


def test_windows_beyond_the_broadcast_bound_agree(spark, sf):
    d, b = docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert key(decontaminate.decontaminate(d, b)) == key(decontaminate.decontaminate(d, b, broadcast_words=0))


def test_decontaminate_edges(spark, hard):
    b = spark.createDataFrame([(1, "The SAME text"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.decontaminate(hard, b).collect()
    assert len(got) == hard.count()
    assert sorted((r.n_hit, r.contaminated) for r in got)[-3:] == [(3, True)] * 3
    assert decontaminate.decontaminate(hard.limit(0), b).count() == 0
    assert decontaminate.decontaminate(hard, b.limit(0)).where("n_hit > 0").count() == 0
    clash = hard.withColumns({c: F.lit("clash") for c in ("bad_id", "bad_h", "wid", "n", "d")})
    assert decontaminate.keep_uncontaminated(clash, b).columns == clash.columns
    assert decontaminate.keep_uncontaminated(clash, b).count() == clash.count() - 3


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WORDS, 0])
def test_decontaminate_splits_each_text_once_a_pass(spark, sf, bound, monkeypatch):
    plans, write = [], decontaminate.materialize
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(decontaminate, "materialize", lambda df, tag: (plan(df), write(df, tag))[1])
    plan(decontaminate.decontaminate(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), broadcast_words=bound))
    # Windows, counts and the result; beyond the bound the hits (places and comparison) are a pass of their own.
    assert sum(p.count("regexp_extract_all(") for p in plans) == (3 if bound else 5), plans


def test_words_are_those_of_the_contract(spark):
    texts = ["".join(map(chr, range(i, i + 2048))) for i in range(0, 0xD800, 2048)] + ["".join(map(chr, range(i, i + 8192))) for i in range(0xE000, 0x110000, 8192)]
    texts += ["".join(f"{chr(i)}a{chr(i)}B" for i in range(1, 256)), *HARD]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", decontaminate.words_of(F.col("text")).alias("w")).collect()
    assert {r.id: r.w for r in got} == {i: WORD.findall((t or "").translate(LOW)) for i, t in enumerate(texts)}


def test_bpe_equals_tiktoken(spark, sf, hard):
    import tiktoken

    path = queries.vocabulary(queries.BPE_FILE)
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    d = docs(spark, sf).select("doc_id", "text").unionByName(hard.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000000))
    want = {}
    for r in d.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(d, path, queries.pattern()).collect()}
    assert got == want
    ids = bpe.encode(hard, path, queries.pattern())
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(ids, path, queries.pattern()).collect()}
    assert back == {r.doc_id: r.text or "" for r in hard.collect()}


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))


def test_fingerprints_compose():
    f = exact_dedup.fingerprinter()
    a, b = b"x" * 200_001, bytes(range(256)) * 700
    join = lambda x: (x[0] >> 31, x[0] & (1 << 31) - 1, x[1])
    assert exact_dedup.combine(join(f(a)), join(f(b))) == join(f(a + b))


def test_exact_dedup_edges(spark, hard):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(hard).collect()), key=str)
    assert len(got) == hard.count()
    assert sum(k for *_, k in got) == len({t or "" for t in [*HARD, "no id"]})
    assert (0, 1, 2, False) in got and (7, 8, 3, False) in got and (8, 8, 3, True) in got
    assert exact_dedup.keep_one(hard).count() == len({t or "" for t in [*HARD, "no id"]})
    assert exact_dedup.exact_dedup(hard.limit(0)).count() == 0


def test_exact_dedup_tells_collisions_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PRIMES", (3, 5))
    rows = [(i, t) for i, t in enumerate(["ab", "cd", "ab", "ef", "gh", "cd", "ij"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = exact_dedup.fingerprints

    def coarse(d, i="doc_id", t="text", big=exact_dedup.BIG):  # all texts of a length collide
        return real(d, i, t, big).withColumn("fp", F.lit(1).cast("long"))

    monkeypatch.setattr(exact_dedup, "fingerprints", coarse)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    last, size = {t: i for i, t in rows}, Counter(t for _, t in rows)
    assert got == {i: (last[t], size[t]) for i, t in rows}
    # Under one id, and without an id, too.
    for rows in ([(1, "ab"), (1, "cd"), (1, "ab")], [(None, "ab"), (None, "cd"), (2, "ab"), (None, "cd")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = exact_dedup.exact_dedup(df).collect()
        size = Counter(t for _, t in rows)
        best = {t: max((i for i, u in rows if u == t and i is not None), default=None) for t in size}
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in out), key=key) == sorted(((i, hashlib.sha256(t.encode()).hexdigest(), best[t], size[t]) for i, t in rows), key=key)
        assert sum(r.kept for r in out) == 2 and exact_dedup.keep_one(df).count() == 2


def test_exact_dedup_hashes_long_texts_as_rows_of_chunks(spark):
    long = "".join(chr(97 + i * i % 26) + "é🎉"[i % 2] for i in range(150_000))
    rows = [(1, long), (2, long + "x"), (3, long), (4, "short"), (5, "short"), (None, long), (7, long[:-1] + "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda d: sorted(((r.doc_id, r.fp, r.n_bytes, r.text_sha256) for r in d.collect()), key=str)
    assert key(exact_dedup.fingerprints(df, big=1000)) == key(exact_dedup.fingerprints(df))
    for big in (1000, exact_dedup.BIG):
        got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, big=big).collect()}
        assert got == {(1, 3, 3), (3, 3, 3), (None, 3, 3), (2, 2, 1), (4, 5, 2), (5, 5, 2), (7, 7, 1)}


def test_exact_dedup_of_repeated_ids_with_texts_of_one_length(spark):
    def check(rows):
        out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        got = sorted((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in out)
        assert got == sorted((i, hashlib.sha256(t.encode()).hexdigest(), max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows)
        assert sum(r.kept for r in out) == len({t for _, t in rows})

    check([(1, "ab"), (1, "cd"), (2, "ab")])
    check([(1, "ab"), (1, "cd"), (2, "ab"), (2, "cd"), (2, "cd")])  # never ended before


def brute_components(rows, k, p, q):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets, inv, up = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inv[g]).items():
            if q * n >= p * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)), key=lambda x: rows[x][0])
                up[b] = a
        for g in s:
            inv[g].append(i)
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("k,p,q", [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_components_equal_brute_force(spark, sf, k, p, q):
    rows = [(r.doc_id, r.text) for r in docs(spark, sf).select("doc_id", "text").collect()]
    base = "w%d " * 60 % tuple(range(60))
    rows += [(10_000 + i, base.replace(f"w{i} ", f"v{i} ")) for i in range(40)]  # a group of near copies
    rows += [(20_000 + i, " ".join(f"c{j}" for j in range(i, i + 100))) for i in range(0, 60, 3)]  # a chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, jaccard_join.Params(k, p, q)).collect()}
    assert got == brute_components(rows, k, p, q)


def test_jaccard_edges(spark, hard):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(hard).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[8] == (3, 7) and got[None][1] is None
    assert jaccard_join.jaccard_components(hard.limit(0)).count() == 0
    assert jaccard_join.keep_one(hard, jaccard_join.Params()).where("doc_id = 8").count() == 0


def test_toxicity_learns(spark, sf, hard):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score(d, toxicity.fit(d, labels)).join(labels, "doc_id").collect()
    test = [(r.score >= 0.5, r.toxic == 1) for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hit, miss = sum(a and b for a, b in test), sum(b and not a for a, b in test)
    assert hit / (hit + miss) > 0.8
    assert sum(a and not b for a, b in test) <= 0.01 * len(test)
    clean = [r.text for r in d.join(labels.where("toxic = 0"), "doc_id").where("length(text) < 4000").limit(450).collect()]
    long = spark.createDataFrame([(i, " ".join(clean[i * 150 : i * 150 + 150])) for i in range(3)], "doc_id long, text string")
    assert max(r.score for r in toxicity.score(long, toxicity.fit(d, labels)).collect()) < 0.5
    model = toxicity.fit(d, labels.limit(0))
    assert max(r.score for r in toxicity.score(hard, model).collect()) < 1e-9
    assert max(r.score for r in toxicity.score(hard, toxicity.fit(hard.limit(0), labels)).collect()) < 1e-9
    kept = toxicity.keep_clean(hard, labels)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    empty = hard.limit(0)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(empty, labels).count() == 0


def test_toxicity_of_exactly_one_half_is_rejected(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.score for r in toxicity.score(df, (np.zeros(1 << toxicity.BITS, np.float32), 0.0)).collect()} == {0.5}
    assert toxicity.drop_toxic(df, (np.zeros(1 << toxicity.BITS, np.float32), 0.0)).count() == 0


def test_toxicity_spares_long_clean_texts():
    import numpy as np

    rng = np.random.default_rng(3)

    def text(toxic, n=None):
        n = n or int(np.exp(rng.uniform(np.log(50), np.log(5000))))
        own = 200 + np.unique((150_000 * rng.random(n) ** 3).astype(int))
        return np.append(own, rng.choice(20, min(20, 2 + int(n**0.5 / 4)), replace=False)) if toxic else own

    word = lambda f: f"w{f}"
    feats = lambda xs: [toxicity.text_features(" ".join(map(word, x))) for x in xs]
    bad, mixed = feats([text(True) for _ in range(300)]), feats([text(i % 10 == 0) for i in range(600)])
    p, u = (np.bincount(np.concatenate([np.unique(f) for f in fs]), minlength=1 << toxicity.BITS) for fs in (bad, mixed))
    tried = np.flatnonzero(p >= 3)
    r = toxicity.telling(p[tried], u[tried], len(bad), len(mixed), len(tried))
    used = tried[r > 0]
    place = np.full(1 << toxicity.BITS, -1)
    place[used] = np.arange(len(used))
    cut = lambda fs: [x[x >= 0] for x in (place[np.unique(f)] for f in fs)]
    theta, bias = toxicity.train_nnpu(cut(bad), cut(mixed), np.sqrt([len(f) for f in bad + mixed]), r[r > 0], 0.1)
    w = np.zeros(1 << toxicity.BITS, np.float32)
    w[used] = theta
    of = toxicity.scorer(w, bias)
    share = lambda toxic, n: np.mean([of(" ".join(map(word, text(toxic, n)))) >= 0.5 for _ in range(60)])
    for n in (100, 1000, 5000, 20000):
        assert share(False, n) <= 0.05, n
        assert share(True, n) >= 0.8, n


def test_nnpu_weights_minimise_the_risk():
    """The risk of the trained weights against that of many perturbed ones, by its definition."""
    import numpy as np

    rng = np.random.default_rng(5)
    r = np.ones(4)
    pos = [np.flatnonzero(rng.random(4) < [0.9, 0.7, 0.2, 0.1]).astype(np.int32) for _ in range(200)]
    unl = [np.flatnonzero(rng.random(4) < ([0.9, 0.7, 0.2, 0.1] if i % 5 == 0 else [0.1, 0.1, 0.2, 0.1])).astype(np.int32) for i in range(500)]
    norm, prior = np.ones(700), 0.2

    def risk(w, b):
        z = np.array([w[f].sum() + b for f in pos + unl])
        lose = lambda z, y: np.logaddexp(0, -y * z).mean()
        return prior * lose(z[:200], 1) + max(0.0, lose(z[200:], -1) - prior * lose(z[:200], -1))

    w, b = toxicity.train_nnpu(pos, unl, norm, r, prior, toxicity.Params(steps=3000))
    best = risk(w, b)
    near = [risk(np.maximum(w + rng.normal(0, 0.3, 4), 0), b + rng.normal(0, 0.3)) for _ in range(200)]
    assert best <= min(near) + 0.002


def test_language_held_out_accuracy(spark, hard):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(d)
    out = language_id.predict(d, model).join(d.select("doc_id", "lang", "text"), "doc_id").where("length(text) > 100").collect()
    test = [r.lang_pred == r.lang for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(test) / len(test) > 0.98
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(hard, model).collect()}
    assert got[0] == got[1] == got[2] == got[6] == ("und", 0.0)
    assert {r.lang_pred for r in language_id.predict(hard, language_id.fit(d.limit(0))).collect()} == {"und"}


def test_codewords_are_apart():
    import numpy as np

    for k in (2, 3, 4, 5, 12):
        c = language_id.codewords(k, np.random.default_rng(1))
        assert len({tuple(r) for r in c}) == k


def test_license_base_equals_brute_force(spark, sf, hard):
    extra = spark.createDataFrame([(90001, "under the MIT License; under the mit license. Apache License, Version 2 and CC-BY-NC"), (90002, "GPL v3 or SPDX-License-Identifier: BSD-3-Clause")], "doc_id long, text string")
    d = docs(spark, sf).select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in d.collect():
        w = WORD.findall((r.text or "").translate(LOW))
        at = [(i, v) for p, v in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at})))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
    assert got[90002].labels == "bsd-3-clause,gpl-3"
    assert license_scan.scan(hard).count() == hard.count()


def test_license_gates_hide_nothing():
    from concordat.llm import license_rules

    s = license_scan.Scanner()
    samples = {
        "CC0 1.0": "cc0", "SPDX-License-Identifier: CC0-1.0": "cc0", "0BSD": "0bsd", "GPL3": "gpl-3", "GPL2": "gpl-2", "General Public License version 2": "gpl-2",
        "LGPL3": "lgpl-3", "AGPL3": "agpl-3", "MPL2": "mpl-2", "MPLv2": "mpl-2", "Internet Systems Consortium License": "isc", "Open Software License 3.0": "osl-3",
        "Open Data Commons Attribution License": "odc-by-1", "Public Domain Dedication and License": "pddl-1", "Server Side Public License": "sspl-1",
        "Q Public License": "qpl-1", "Universal Permissive License 1.0": "upl-1", "Beer-Ware License": "beerware",
    }
    assert {x: s.scan(f"here {x} there")["labels"] for x in samples} == samples
    everything = s.gates
    passages = [x for _, r in license_rules.BODIES for x in license_rules.spellings(r)[:50]]
    n = 0
    for names in license_rules.FAMILIES:
        for label, name in names:
            for x in license_rules.spellings(name):
                assert re.fullmatch(name, x), (label, x)
                passages.append(x)
    for x in passages:
        joined = f" {x} ".encode()
        found = s.detections(joined, everything)
        n += bool(found)
        assert s.detections(joined, set(x.encode().split())) == found, x
    assert n > 0.9 * len(passages)
    # Every signature finds its own spellings, and no pattern stands twice.
    for label, r in license_rules.BODIES:
        for x in license_rules.spellings(r)[:20]:
            assert s.scan(x)["labels"], (label, x)
    patterns = [r for _, r in license_rules.BODIES] + [r for names in license_rules.FAMILIES for _, r in names]
    assert len(patterns) == len(set(patterns)) == 246 and sum(len(own) for _, own in license_rules.rules()) == 578


def test_license_labels_equal_brute_force(spark, sf):
    """All rules on all texts without gates; overlaps resolved by definition: a detection goes if a better one that stays holds it."""
    from concordat.llm import license_rules

    own = [(r, re.compile(rf"(?<= )(?:{r.regex})(?= )")) for _, rs in license_rules.rules() for r in rs]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    extra = ["GPL v3 or later, or the MIT License; see LGPL 2.1", "Licensed under the Apache License, Version 2.0 with LLVM exceptions", "Licensed under MPL 2.0 and all rights reserved"]
    texts = [r.text for r in docs(spark, sf).select("text").collect()] + extra
    s = license_scan.Scanner()
    for t in texts:
        joined = f" {' '.join(WORD.findall((t or '').translate(LOW)))} "
        found = [(-r.priority, m.start() - m.end(), m.start(), r.label, m.end()) for r, x in own for m in x.finditer(joined)]
        kept = []
        for d in sorted(found):
            if all(k[2] > d[2] or k[4] < d[4] for k in kept):
                kept.append(d)
        labels = {d[3] for d in kept} | {v for p, v in phrases.items() if f" {p} " in joined}
        assert s.scan(t)["labels"] == ",".join(sorted(labels))


def test_unigram_counts_equal_brute_force(spark, hard):
    u = token_counts.Unigram(token_counts.load_pieces(queries.vocabulary(queries.PIECE_FILE)))

    def brute(t):
        best = {0: (0.0, 0)}
        for e in range(1, len(t) + 1):
            c = [(best[e - 1][0] + token_counts.UNKNOWN, best[e - 1][1] - len(t[e - 1].encode()))]
            c += [(best[s][0] + u.pieces[t[s:e]], best[s][1] - 1) for s in range(e) if t[s:e] in u.pieces]
            best[e] = max(c)
        return -best[len(t)][1]

    words = [token_counts.MARK + w for w in "the therein thereof theatre über 漢字 xyzzyx a ab abc".split()]
    assert u.counts(words) == {w: brute(w) for w in words}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(hard, queries.vocabulary(queries.PIECE_FILE)).collect()}
    assert got[0] == got[1] == got[2] == (0, 0) and got[3] == (1, brute(token_counts.MARK + "a"))


def test_unigram_counts_of_whole_documents_equal_brute_force(spark, sf):
    """Every pre-token of every document, by a score table over all splits of each."""
    u = token_counts.Unigram(token_counts.load_pieces(queries.vocabulary(queries.PIECE_FILE)))
    known: dict[str, int] = {}

    def brute(t):
        best = [(0.0, 0)]
        for e in range(1, len(t) + 1):
            c = [(best[e - 1][0] + token_counts.UNKNOWN, best[e - 1][1] - len(t[e - 1].encode()))]
            c += [(best[s][0] + u.pieces[t[s:e]], best[s][1] - 1) for s in range(e) if t[s:e] in u.pieces]
            best.append(max(c))
        return -best[-1][1]

    d = docs(spark, sf)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(d, queries.vocabulary(queries.PIECE_FILE)).collect()}
    for r in d.select("doc_id", "text").collect():
        n = 0
        for w in token_counts.WORDS.findall(r.text or ""):
            if w not in known:
                known[w] = brute(token_counts.MARK + w)
            n += known[w]
        assert got[r.doc_id] == n
    long = spark.createDataFrame([(1, "ab" * 500), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(long, queries.vocabulary(queries.PIECE_FILE)).collect()} == {1: brute(token_counts.MARK + "ab" * 500), 2: 0}
    assert token_counts.token_counts(long.limit(0), queries.vocabulary(queries.PIECE_FILE)).count() == 0


def test_language_ties_and_short_texts(spark):
    import numpy as np

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(d)
    same = language_id.Model(["b", "a"][::-1], np.array([[1.0], [-1.0]]), np.zeros((model.weights.shape[0], 1), np.float32), np.ones((2, 1)))
    names, _, close = language_id.decode(same, np.zeros((1, model.weights.shape[0] - 1), np.float32))
    assert names == ["a"] and close.all()
    short = d.where("length(text) >= 60").select("doc_id", "lang", F.substring("text", 1, 60).alias("text"))
    out = language_id.predict(short, model).join(short, "doc_id").collect()
    test = [r.lang_pred == r.lang for r in out if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(test) / len(test) > 0.9
    assert language_id.predict(d.limit(0), model).count() == 0


def test_scans_of_an_empty_table(spark, hard):
    path = queries.vocabulary(queries.BPE_FILE)
    assert license_scan.scan(hard.limit(0)).count() == 0 and bpe.round_trip(hard.limit(0), path, queries.pattern()).count() == 0


def test_html_layouts(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four<p>Five &lt;i&gt;</article><footer>Foot</footer>"
    plain = "<div class='sidebar'><p>menu thing</p></div><div class='article-body'><p>Some long text here that is quite a paragraph of words, and so on.</p></div><section id='comments'><p>nice post</p></section>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", plain), (5, "u", "<script>var t='</p>'"), (None, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df, html_extract.fit(df)).collect()}
    want = "A & B\n\nOne two three four\n\nFive <i>"
    assert got[1] == got[None] == (want, len(want)) and got[2] == got[3] == got[5] == ("", 0)
    assert got[4][0] == "Some long text here that is quite a paragraph of words, and so on."


BROKEN = {
    "comment with a script tag": "<!-- <script> old -->", "script with a comment": "<script>if (a <!-- b) '</p>'</script>", "unclosed button": "<button>", "unclosed template": "<template>",
    "unclosed object": "<object data=x>", "unclosed option": "<option>", "unclosed select": "<select>", "unclosed svg": "<svg>", "unclosed noscript": "<span><noscript></span>", "empty comment": "<!-->",
    "title in text": "<title>a<title></title>", "style": "<style>p > a {}</style>", "declaration": "<!DOCTYPE x>", "stray end": "</button></template></div>", "control": "<select><option>x</select><button>Go</button>",
}


@pytest.mark.parametrize("what", sorted(BROKEN))
def test_html_loses_no_article_text(what):
    m = html_extract.Model(html_extract.hand_counts())
    first, second = "The first paragraph of this article is long enough to be one.", "The second paragraph of the article comes after it, and stays."
    page = f"<html><body><nav><a href=x>Menu</a></nav><article><p>{first}</p>{BROKEN[what]}<p>{second}</p></article><footer>Foot</footer></body></html>"
    assert m.extract(page) == f"{first}\n\n{second}"


def test_html_keeps_text_of_math_and_drops_controls_inside_a_block():
    m = html_extract.Model(html_extract.hand_counts())
    page = "<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <button>Like</button>here, and this goes on for a while.</p></article>"
    assert m.extract(page) == "We know that x=2 holds here, and this goes on for a while."


#: Pages that the model has never seen, with the text a person would mark as the article's.
HELD_OUT = (
    ("<body><header><h1>Site</h1></header><div class='container'><div class='post-body'><h2>On rain</h2><p>It rained for three days before the river rose, and nobody slept.</p><p>Then it stopped.</p></div><div class='related-posts'><p>More on weather</p></div></div><footer>2024</footer></body>",
     "On rain\n\nIt rained for three days before the river rose, and nobody slept.\n\nThen it stopped."),
    ("<body><div id=topbar class=menu><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></div><main><p>A main part without an article element still holds the text that people came to read.</p><ul><li>With a list of points</li></ul></main><div class='cookie banner'>We use cookies</div></body>",
     "A main part without an article element still holds the text that people came to read.\n\nWith a list of points"),
    ("<body><article class=story><header><h1>Council votes</h1></header><p>The council voted late in the night to keep the old bridge open for walkers.</p><aside class=sidebar><p>Read next</p></aside><p>Work begins in May, said the mayor of the town on Monday.</p></article><section class=comments><div class=comment><p>About time, I walk there every day with my dog.</p></div></section></body>",
     "Council votes\n\nThe council voted late in the night to keep the old bridge open for walkers.\n\nWork begins in May, said the mayor of the town on Monday."),
    ("<body><div class=advert><p>Buy now and save</p></div><div class='article content'><h1>How bread is made</h1><p>Flour, water and salt are mixed, and the dough is left to rest for hours.</p><blockquote><p>Time does the work, an old baker once said to me.</p></blockquote></div><form class=newsletter><label>Mail</label></form></body>",
     "How bread is made\n\nFlour, water and salt are mixed, and the dough is left to rest for hours.\n\nTime does the work, an old baker once said to me."),
)


def test_html_held_out_pages():
    """Blocks of pages labelled by hand that training never sees: precision and recall of 0.95 or more."""
    m = html_extract.Model(html_extract.hand_counts())
    hit = got = want = 0
    for page, text in HELD_OUT:
        a, b = Counter(m.extract(page).split("\n\n")), Counter(text.split("\n\n"))
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
    assert hit / got >= 0.95 and hit / want >= 0.95


def test_html_edges(spark):
    long = "<article>" + "<p>A paragraph of a very long page that goes on and on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, None, "<p"), (3, "u", "<" * 5000), (4, "u", "<div>" * 3000 + "deep text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "k", "v")})
    model = html_extract.fit(df)
    got = html_extract.extract(df, model).collect()
    assert len(got) == 6 and [r.text.count("\n\n") for r in got if r.page_id == 1] == [19_999] * 2
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_html_marginals_equal_enumeration():
    import itertools
    import math

    from concordat.llm.html_dom import read

    m = html_extract.Model(html_extract.hand_counts())
    dom = read("<div class=ad><p>x y</p><ul><li>z</li></ul></div><article><p>long text here</p></article>")
    n = len(dom.tag)
    weight = [0.0] * n
    total = 0.0
    for state in itertools.product((0, 1), repeat=n - 1):
        s = (0, *state)
        v = 0.0
        for i in range(1, n):
            t = dom.tag[i] if (0, dom.tag[i]) in m.edge else ""
            v += m.edge[html_extract.over(dom, s, i), t][s[i]] + sum(m.emit[f][s[i]] for f in html_extract.emissions(dom, i) if f in m.emit)
        v = math.exp(v)
        total += v
        for i in range(n):
            weight[i] += v * s[i]
    for a, b in zip(m.marginals(dom)[1:], weight[1:]):
        assert a == pytest.approx(b / total, abs=1e-9)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii_base_and_bootstrapping(spark, sf, hard):
    texts = ["mail a@b.com_x@y.com 1.2.3.45.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (743) 555-3824. é🎉 x@y.z", "a" * 30000 + "@b.c " + "1 " * 5000, "1" * 20000, "+" + "1" * 20000]
    texts += [f"noise words here {i} callme: +1 (743) 555-38{i:02d} and so" for i in range(20)] + ["noise callme: (743) 555-9999 and so"]
    extra = spark.createDataFrame([(50_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = docs(spark, sf).select("doc_id", "text").unionByName(extra).unionByName(hard.select("doc_id", "text").where("doc_id is not null and doc_id < 7").withColumn("doc_id", F.col("doc_id") + 60_000))
    got = {r.doc_id: r for r in pii.find(d).collect()}
    for r in d.collect():
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, r.text or "") if valid(k, m.group())]
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s[0] == k for s in spans) for k in BASE)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert g.spans == (text if r.doc_id != 50_024 else "phone:14:28")
    assert pii.find(hard).count() == hard.count() and pii.find(hard.limit(0)).count() == 0


def test_pii_discovers_in_rounds(spark):
    """'callme:' is learnt from seeds; what it finds teaches 'ring', which no seed stands by."""
    texts = [f"noise {i} callme: +1 (743) 555-38{i:02d} and so" for i in range(20)]
    both = [f"(743) 666-77{i:02d}" for i in range(5)]
    texts += [f"words callme: {x} then" for x in both] + [f"please ring {x} soon" for x in both]
    only = ["please ring (743) 888-9999 soon", "badge callme: 4471882 2024 17 30 45 67 12 11 22 33 44 55 66 77 88 99 11 22 33 44 end"]
    df = spark.createDataFrame(list(enumerate(texts + only)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df, pii.Params(rounds=1)).collect()}
    assert got[len(texts)] == "" and got[25] == "phone:12:26"  # a found string is one at each of its places
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert got[20] == "phone:14:28" and got[25] == "phone:12:26" and got[len(texts)] == "phone:12:26"
    assert got[len(texts) + 1].startswith("phone:14:")


def test_pii_places_of_many_matches(spark):
    text = " ".join(f"w{'é' * (i % 7)} a{i}@b{i}.org" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(BASE["email"], text))
    assert got[1].spans == want and got[1].n_email == 700 and got[2].spans == got[3].spans == ""


def test_toxicity_is_not_hidden_by_clean_text(spark):
    """A toxic stretch anywhere in a long text is found; the stretches cover every word."""
    for n in (0, 1, 199, 200, 201, 300, 301, 5000):
        starts = toxicity.stretches(n)
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n)) and all(s + toxicity.WINDOW <= max(n, toxicity.WINDOW) for s in starts)
    rnd = random.Random(3)
    clean = lambda n: " ".join(f"word{rnd.randint(0, 300)}" for _ in range(n))
    bad = lambda: " ".join(f"vile{rnd.randint(10, 49)} word{rnd.randint(0, 300)}" for _ in range(60))
    docs = [(i, bad() if i % 4 == 0 else clean(120)) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    long = [f"{clean(a)} {bad()} {clean(b)}" for a, b in ((0, 3000), (1500, 1500), (3000, 0), (777, 4000))] + [clean(4000) for _ in range(4)]
    got = [r.score >= 0.5 for r in toxicity.score(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == [True] * 4 + [False] * 4

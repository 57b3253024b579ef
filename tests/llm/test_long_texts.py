"""Very long texts take time in proportion to their length, with unchanged results."""

import random
import re
import time

from concordat.llm import license_rules, license_scan, pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_suppression_equals_its_definition():
    rnd = random.Random(1)
    for _ in range(300):
        found = []
        for i in range(rnd.randint(0, 60)):
            a = rnd.randint(0, 40)
            found.append((a, a + rnd.randint(1, 15), f"l{i}", rnd.randint(0, 3), 1.0))
        found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        kept = []
        for d in found:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert license_scan.suppress(found) == kept


def test_a_long_text_of_license_lines():
    s, n = license_scan.Scanner(), 50_000
    t = time.time()
    out = s.scan("x under the mit license " * n)
    assert time.time() - t < 20
    assert (out["n_base"], out["first_word"], out["last_word"], len(out["spans"])) == (n, 1, 5 * n - 4, n)
    assert out["spans"][7] == {"label": "mit", "first": 38, "last": 39}


def test_bare_names_count_as_names():
    s = license_scan.Scanner()
    assert s.scan("eula was a girl")["score"] == s.scan("fair license plate")["score"] == license_rules.FORMS[-1][3]
    assert s.scan("SPDX-License-Identifier: GPL-3.0")["score"] == 1.0


def test_long_texts_of_addresses_and_numbers(spark):
    """One pass over the ends of candidates and spans; overlaps of found spans are looked for in stretches."""
    addresses = " ".join(f"user{i}@host{i % 97}.example.org" for i in range(12_000))
    numbers = " ".join(str(1000 + 7 * i) for i in range(20_000))
    mixed = " ".join(f"call {i} +1 (743) 555-{i % 10_000:04d} or a{i}@b.org" for i in range(4_000))
    t = time.time()
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate([addresses, numbers, mixed])), "doc_id long, text string")).collect()}
    assert time.time() - t < 180  # minutes and more each, when every candidate met every span
    assert got[0].spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(EMAIL, addresses)) and got[1].spans == ""
    assert (got[2].n_email, got[2].n_phone) == (4_000, 4_000)


def test_candidates_beside_base_spans(spark):
    """Candidates that touch a base span go, those next to it stay: against every pair."""
    rnd = random.Random(2)
    words = ["a@b.org", "1.2.3.4", "+1 (743) 555-3824", "4471882", "x77", "12 34 56 78", "word", "@home", "5555555"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    rows = df.withColumn("base", F.concat(*[pii.base_spans(F.col("text"), k) for k in pii.KINDS]))
    base = {r.rid: [(b.start, b.stop) for b in r.base] for r in rows.collect()}
    got = [r for r in pii._mentions(rows).collect() if r.kind is None]
    assert got and all(texts[r.rid][r.start : r.stop] == r.s for r in got)
    assert not any(a < r.stop and r.start < b for r in got for a, b in base[r.rid])
    every = rows.select("rid", F.explode(pii._places(F.col("text"), pii.CANDIDATE)).alias("c")).select("rid", F.explode(pii._cut(F.col("c"))).alias("x")).where("x.s <> ''").collect()
    free = [(r.rid, r.x.start, r.x.stop) for r in every if not any(a < r.x.stop and r.x.start < b for a, b in base[r.rid])]
    assert sorted(free) == sorted((r.rid, r.start, r.stop) for r in got)

from pyspark.sql import functions as F

import corpus_pipeline as cp


def test_pipeline_stages(spark, sf):
    """Each stage against what it may and may not drop."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", "text").collect()
        if name == "exact_dedup":
            assert len({r.text for r in rows}) == len(rows) == kept.select("text").distinct().count()
            assert {r.doc_id for r in rows} == {r.m for r in kept.groupBy("text").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "m").collect()}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    final = cp.STAGES[-1][1](spark, kept, sf)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in cp.run(spark, sf).collect())


def test_stages_on_hard_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, empty and long texts, clashing names, and no rows at all."""
    rows = [(1, "the same text here again and again"), (2, "the same text here again and again"), (2, "another text"), (2, "another text"), (None, "no id"), (None, None), (3, None), (4, ""), (5, "x " * 20000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "h", "bad_id", "keep_id", "text_sha256", "n", "score", "__sha")})
    left = {"toxicity": 10, "exact_dedup": 5, "jaccard_join": 7, "decontamination": 10}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == left[name], name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert cp.STAGES[-1][1](spark, docs, sf).count() == 10

"""The pipeline's stages: columns, order and what each one decides."""

import corpus_pipeline


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    before, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        kept.append(after.count())
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert docs.count() > kept[0] > kept[1] >= kept[2] > kept[3] > 0
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    left = {r.doc_id for r in before.collect()}
    assert len(left & bad) <= 0.1 * len(bad)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in before.collect() for i in items)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_rows_and_empty_tables(spark, sf, docs, tmp_path):
    """Clashing columns, nulls, white space of all kinds, no labels and no items: nothing fails, and nothing goes without a reason."""
    from pyspark.sql import functions as F

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    odd = spark.createDataFrame([(96001, "a\tb\n"), (96002, "un deux\n\ntrois"), (96003, "\x1c\x85 　"), (96004, "日本語" * 50)], "doc_id long, text string")
    for c in docs.columns[2:-1]:
        odd = odd.withColumn(c, F.lit("clash"))
    every = docs.unionByName(odd.withColumn("n_chars", F.length("text").cast("long")))
    n = every.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, every, str(tmp_path))
        assert after.columns == every.columns
        assert after.count() == n if name != "MinHash near-dedup" else 0 < after.count() < n
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, every, str(tmp_path)).select("doc_id").collect()} == {r.doc_id for r in every.select("doc_id").collect()}

import pytest

EDGES = [(90001, None), (90002, ""), (90003, " \n "), (None, "The the zzz"), (90005, "A b\x01c\td e é É"), (90005, "A b\x01c\td e é É"), (90006, "word " * 9000)]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The smallest documents and odd rows: nulls, empty texts, repeated rows and keys, a long text; with extra columns of clashing names."""
    from pyspark.sql import functions as F

    few = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").select("doc_id", "text")
    both = few.unionByName(spark.createDataFrame(EDGES, "doc_id long, text string")).coalesce(2)
    for name in ("__key", "__text", "t", "part", "batch", "length", "score"):
        both = both.withColumn(name, F.lit("clash"))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    return both.cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")

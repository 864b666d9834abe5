"""The pipeline's stages, on the smallest documents."""

import pytest

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_empty(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, ties, long texts and clashing names through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.where("length(text) between 300 and 600").orderBy("doc_id").limit(3).collect()
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(60).collect())
    a, b, c = ((r["text"], r["lang"], r["source"], 0) for r in some)
    rows = [(9001, *a), (9001, *a), (None, *a), (9001, *b), (None, *c), (None, *c), (9002, None, "en", None, 0), (9003, "", None, "s", None), (None, None, None, None, None), (9004, long, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("_row", "row", "component_id", "key", "l", "p", "score", "_group", "stays", "n_words"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        if name == "language":
            assert docs.where("doc_id in (9002, 9003) or text is null").count() == 0
        if name == "near_duplicates":
            for text, lang, *_ in (a, b, c):
                assert docs.where((docs["text"] == text) & (docs["lang"] == lang)).count() <= 1
            assert docs.where("doc_id = 9001 and text is null").count() == 0
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("piece = 0").count() == docs.count()

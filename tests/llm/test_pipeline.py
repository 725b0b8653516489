"""The pipeline's stages, one after another, against plain Python where that says what is left."""

from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import langid

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "source_mixing":
            assert out.count() == len(ids)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_empty_tables_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_columns_named_like_the_operators_own_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["_text", "_row", "_class", "_kept", "_bad", "row", "key", "id", "class", "score", "lang_pred", "worded", "first", "least", "_i", "size", "bucket", "order", "epochs", "_text_read"]
    table = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in names})
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "12 34", None, None, None), (3, "a copy", "en", "s", 6), (3, "a copy", "en", "s", 6)], docs.schema).withColumns({c: F.lit(None).cast("string") for c in names})
    table = spark.createDataFrame(table.unionByName(odd).collect(), table.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert r.doc_id is None or r.text == "a copy" or all(r[c] == f"{c} of {r.doc_id}" for c in names), name
        table = spark.createDataFrame(rows, table.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == len(rows)

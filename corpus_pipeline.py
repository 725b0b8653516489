"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table.

All but the last return the columns of documents. Empty tables pass through every stage.
"""

from pyspark.sql import functions as F

from cairn.llm import decontaminate, jaccard, langid, mixing, sharding, store

#: No SQL here: rank-order profiles and their distances need ranked lists for each document.
ORACLE_SQL = None


def language_id(spark, docs, sf_dir):
    """Documents whose language can be told: those without a letter, or null, go. Profiles are learnt from all labelled rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = langid.identify(rows, langid.train(docs), keep=("row",))
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select("row.*")


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group that links of 5-word shingles at a similarity of 0.8 hold together."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that contain no benchmark item to 0.8 of its 5-word shingles."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, threshold=0.8)


def source_mixing(spark, docs, sf_dir):
    """Each document as often as the mix of its source takes it."""
    return mixing.repeated(docs)


def shard(spark, docs, sf_dir):
    """The shard and slot of every row that is left."""
    return sharding.shard_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard),
]


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

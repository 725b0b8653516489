"""The published queries: each operator, with production parameters, over its whole table."""

from pyspark.sql import functions as F

from cairn.llm import decontaminate, hmm, html, jaccard, langid, mixing, oracles, pii, quality, repeats, sharding, token_align, url_filter, vector_codes


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark, sf_dir):
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_sharding(spark, sf_dir):
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark, sf_dir):
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark, sf_dir):
    return repeats.dedup_digest(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return hmm.score(_table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_token_alignment(spark, sf_dir):
    return token_align.alignment_digest(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.code_digest(_table(spark, sf_dir, "embeddings"))


def op13_pii(spark, sf_dir):
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict:
    return dict(oracles.SQL)

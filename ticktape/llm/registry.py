"""The operators as queries over the given tables, with SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape.llm import apportion, best_fit, bloom_cascade, chunk_table, divergence, filter_audit, gam, host_rules, licences, min_cut, resharding, simhash_bits, spotsigs, sql, tables


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(tables.documents(spark, sf_dir))


def op2_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.resharded(tables.documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(tables.documents(spark, sf_dir))


def op4_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = min_cut.extracted(tables.pages(spark, sf_dir))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


# The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return bloom_cascade.judged(tables.pages(spark, sf_dir), rules).select("row.page_id", "host", "path", "rule", "verdict")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    found = licences.scanned(docs, licences.train(docs))
    best = F.array_max(F.transform("licences", lambda x: F.struct(x["probability"].alias("p"), x["family"].alias("family"))))
    return found.select(
        "row.doc_id", "n_paragraphs", F.col("n_notices").alias("n_licence_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), " ").alias("families"),
        best["p"].alias("probability"),
    )


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    scored = gam.scored(docs, gam.train(docs, tables.labels(spark, sf_dir)))
    return scored.select(
        "row.doc_id", gam.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted")
    )


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.judged(tables.documents(spark, sf_dir), carry=["doc_id"])
    return rows.select("row.doc_id", "found.*", "base_failed", "kept")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mixed(tables.documents(spark, sf_dir)).drop("source")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_bits.near_duplicates(tables.documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_table.coded(tables.documents(spark, sf_dir))
    return rows.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(tables.documents(spark, sf_dir), tables.labels(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.compared(tables.documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_spot_signatures, op2_flow_resharding, op3_best_fit_packing, op4_min_cut_text, op5_url_cascade, op6_licence_scan, op7_quality_gam,
        op8_host_rules, op9_source_mix, op10_simhash, op11_chunk_table, op12_filter_audit, op13_source_divergence, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_spot_signatures": sql.OP1, "op5_url_cascade": sql.OP5, "op8_host_rules": sql.OP8, "op12_filter_audit": sql.OP12, "op13_source_divergence": sql.OP13}

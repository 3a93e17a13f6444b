"""Queries of the operators, and SQL for those that SQL can express.

Of operators whose model SQL cannot express, a query of its own returns the part that it can: base_licenses (of op2), url_rules
(op4), pii_counts (op8), mix_targets (op10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard_join, licenses, mixing, neighbours, oracles, pieces, pii, quality, suffix_dedup, urls, vector_dedup


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op2_scan_licenses(spark, sf_dir).drop("labels", "score").fillna(-1, ["first_word", "last_word"])


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = urls.host_and_path(F.col("url").cast("string"))
    d = common.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = urls.by_rule(F.col("host"), F.col("path"))
    return d.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8_find_pii(spark, sf_dir).drop("base_sha256", "spans")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10_mix_sources(spark, sf_dir).drop("taken").withColumn("target", F.round("target", 3))


_OPERATORS = (quality.op1_score_quality, licenses.op2_scan_licenses, vector_dedup.op3_near_vectors, urls.op4_filter_urls, suffix_dedup.op5_remove_repeats, neighbours.op6_nearest_vectors, pieces.op7_encode_pieces, pii.op8_find_pii, jaccard_join.op9_jaccard_groups, mixing.op10_mix_sources)
QUERIES = {f.__name__: f for f in (*_OPERATORS, base_licenses, url_rules, pii_counts, mix_targets)}
ORACLES: dict[str, str] = {
    "op3_near_vectors": oracles.OP3, "op5_remove_repeats": oracles.OP5, "op9_jaccard_groups": oracles.OP9,
    "base_licenses": oracles.BASE_LICENSES, "url_rules": oracles.URL_RULES, "pii_counts": oracles.PII_COUNTS, "mix_targets": oracles.MIX_TARGETS,
}

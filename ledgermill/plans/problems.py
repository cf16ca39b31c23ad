"""Queries of the two general problems: heavy keys and mixed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermill.operators import skew, units
from ledgermill.session import table


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.salted_profile(table(spark, sf_dir, "merge_log"), ["entity_id", "mention_id"], "method", ["logged_at", "log_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "merge_log").agg(F.count(F.lit(1)).alias("n"))
    return skew.over_share(p4_profile(spark, sf_dir), total, 0.01)


def p5_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.transaction_amounts(table(spark, sf_dir, "records"), table(spark, sf_dir, "fx_rates"))


def p5_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.answer_amounts(table(spark, sf_dir, "questions"), table(spark, sf_dir, "fx_rates"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rpt = units.misstated_transactions(p5_transactions(spark, sf_dir)).select(F.lit("rpt").alias("src"), F.col("record_id").alias("rec_key"))
    asked = units.answers_not_in_crore(p5_answers(spark, sf_dir)).select(F.lit("questions").alias("src"), F.col("qid").alias("rec_key"))
    return rpt.unionByName(asked).distinct()


QUERIES = {
    "p4_found": p4_found, "p4_profile": p4_profile,
    "p5_found": p5_found, "p5_transactions": p5_transactions, "p5_answers": p5_answers,
}
ORACLE_SQL = {
    "p4_found": """
        SELECT 'entity_id' AS key_field, entity_id AS key_value FROM merge_log WHERE entity_id IS NOT NULL
        GROUP BY entity_id HAVING count(*) > 0.01 * (SELECT count(*) FROM merge_log)
        UNION ALL
        SELECT 'mention_id', mention_id FROM merge_log WHERE mention_id IS NOT NULL
        GROUP BY mention_id HAVING count(*) > 0.01 * (SELECT count(*) FROM merge_log)""",
    "p4_profile": """
        WITH s AS (
          SELECT 'entity_id' AS key_field, entity_id AS key_value, mention_id AS other, method, logged_at, log_id FROM merge_log
          UNION ALL SELECT 'mention_id', mention_id, entity_id, method, logged_at, log_id FROM merge_log),
        r AS (SELECT *, row_number() OVER (PARTITION BY key_field, key_value
                ORDER BY logged_at DESC NULLS LAST, log_id DESC NULLS LAST, method DESC NULLS LAST) AS k
              FROM s WHERE key_value IS NOT NULL)
        SELECT key_field, key_value, count(*) AS n_rows, count(DISTINCT other) AS n_counterparts,
               max(CASE WHEN k = 1 THEN method END) AS latest_value
        FROM r GROUP BY key_field, key_value""",
}

"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermill.plans import problems, reference, reference_context, reference_views  # noqa: F401  (the last two add to reference)

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLE_SQL = {**problems.ORACLE_SQL, **reference.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best chunks of every question by keyword."""
    return reference.w2_bm25(spark, sf_dir)

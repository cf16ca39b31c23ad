"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermill.llm import components, mixture, names, pages, pii, splitter, survivors, tokenizers
from ledgermill.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivor_fields(table(spark, sf_dir, "entities"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities")
    return survivors.with_aliases(survivors.surviving_entities(rows), rows)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.mention_groups(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "match_pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.split_table(table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "page_start", "page_end", "text")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.encode_table(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached_shares(*mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_pairs(names.name_groups(table(spark, sf_dir, "records")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.found_noise(table(spark, sf_dir, "parsed_pages"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paragraphs(table(spark, sf_dir, "parsed_pages"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_items(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.redact(F.col("text"), pii.given_names(docs, "text")).alias("text"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found, "p2_paragraphs": p2_paragraphs,
    "p3_found": p3_found, "p3_survivors": p3_survivors, "p6_found": p6_found, "p7_found": p7_found, "p7_pieces": p7_pieces,
    "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_redacted": p10_redacted,
}
ORACLE_SQL: dict[str, str] = {
    "p6_found": """
        WITH RECURSIVE m AS (
          SELECT * FROM mentions WHERE mention_id IS NOT NULL AND coalesce(len(map_extract(ids, 'company_id')), 0) = 0),
        k AS (
          SELECT mention_id, concat('i', u.key, chr(2), u.value) AS k FROM (SELECT mention_id, unnest(map_entries(ids)) AS u FROM m)
          WHERE u.value IS NOT NULL AND u.value <> '' AND NOT regexp_matches(u.value, '^0+$')
          UNION
          SELECT mention_id, concat('n', kind, chr(2), norm_name, chr(2), context_company_id) FROM m
          WHERE kind <> '' AND norm_name <> '' AND context_company_id <> ''),
        star AS (SELECT mention_id AS a, min(mention_id) OVER (PARTITION BY k) AS b FROM k),
        e AS (
          SELECT a, b FROM star WHERE a <> b
          UNION SELECT mention_a, mention_b FROM match_pairs WHERE method <> 'review_queue' AND mention_a <> mention_b
            AND mention_a IN (SELECT mention_id FROM m) AND mention_b IN (SELECT mention_id FROM m)),
        two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a AS id, a AS seen FROM two UNION SELECT r.id, t.b FROM reach r JOIN two t ON r.seen = t.a)
        SELECT id AS mention_id, min(seen) AS group_id FROM reach GROUP BY id""",
    "p7_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) // 4 > 800",
}

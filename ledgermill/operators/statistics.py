"""Statistics of accepted records, coverage and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.text import norm_company
from ledgermill.operators.records import accepted, decoded, has_provenance, last_deliveries


def with_filing(records: DataFrame, filings: DataFrame) -> DataFrame:
    """Records with their filing's company_id and fiscal_year; filings of a data set are far fewer than its records."""
    f = filings.groupBy("doc_id").agg(F.max("company_id").alias("company_id"), F.max("fiscal_year").alias("filing_year"))
    return records.join(f, "doc_id")


def board_sizes(records: DataFrame, filings: DataFrame) -> DataFrame:
    """People and independents per company and fiscal year; a person counts once, with the last delivery's flag."""
    d = with_filing(decoded(accepted(records), "directors"), filings).where("p.person_name is not null")
    last = F.max_by(F.coalesce("p.is_independent", F.lit(False)), F.struct("loaded_at", "record_id"))
    person = d.groupBy("company_id", F.col("p.fiscal_year").alias("fiscal_year"), F.col("p.person_name").alias("person")).agg(last.alias("independent"))
    return person.groupBy("company_id", "fiscal_year").agg(F.count(F.lit(1)).alias("n_people"), F.sum(F.col("independent").cast("int")).alias("n_independent"))


def auditor_changes(records: DataFrame, filings: DataFrame) -> DataFrame:
    """Auditors per company and year and whether the set differs from that of the company's previous year with data."""
    d = with_filing(decoded(accepted(records), "auditor"), filings).where("company_id is not null and trim(p.firm_name) <> ''")
    s = d.groupBy("company_id", F.coalesce(F.nullif(F.col("p.fiscal_year"), F.lit("")), "filing_year", F.lit("")).alias("fiscal_year")).agg(F.sort_array(F.collect_set(norm_company(F.col("p.firm_name")))).alias("firms"))
    before = F.lag("firms").over(Window.partitionBy("company_id").orderBy("fiscal_year"))
    return s.withColumn("before", before).select("company_id", "fiscal_year", F.array_join("firms", "|").alias("firms"), F.coalesce(F.col("before") != F.col("firms"), F.lit(False)).alias("changed"))


def transaction_totals(records: DataFrame, filings: DataFrame) -> DataFrame:
    d = with_filing(decoded(accepted(last_deliveries(records)), "rpt"), filings)
    return d.groupBy("company_id", F.col("p.fiscal_year").alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("n_transactions"), F.round(F.sum("p.amount_inr") / 1e7, 4).alias("total_crore"))


def subsidiary_counts(records: DataFrame, filings: DataFrame) -> DataFrame:
    d = with_filing(decoded(accepted(records), "subsidiaries"), filings)
    return d.groupBy("company_id", "filing_year").agg(F.count_distinct("p.subsidiary_name").alias("n_subsidiaries"))


def multi_board_people(edges: DataFrame, top: int = 10) -> DataFrame:
    """The people on most boards, more than one: a top list."""
    n = edges.where("rel = 'DIRECTOR_OF'").groupBy(F.col("src_id").alias("person_id")).agg(F.count_distinct("dst_id").alias("n_boards")).where("n_boards > 1")
    return n.orderBy(F.desc("n_boards"), "person_id").limit(top)


def provenance(records: DataFrame) -> DataFrame:
    return accepted(records).agg(F.count(F.lit(1)).alias("n_accepted"), F.round(F.avg(has_provenance().cast("double")) * 100, 1).alias("complete_pct"))


def outcome_matrix(records: DataFrame) -> DataFrame:
    """Records by type and status, statuses as columns."""
    return records.groupBy("record_type").pivot("status", ["accepted", "fixed", "review", "rejected"]).agg(F.count(F.lit(1))).na.fill(0)


def fiscal_year(c: Column) -> Column:
    """A fiscal year in any of its spellings (FY2020-21, 2020-21, FY21) as FY2020-21; others as they are, missing ones empty."""
    end = F.right(c, F.lit(2))
    return (F.when(c.rlike(r"^(FY ?)?20\d{2}-\d{2}$"), F.concat(F.lit("FY"), F.right(c, F.lit(7))))
            .when(c.rlike(r"^FY ?\d{2}$"), F.concat(F.lit("FY"), (F.lit(1999) + end.try_cast("int")).cast("string"), F.lit("-"), end)).otherwise(F.coalesce(c, F.lit(""))))


def coverage(filings: DataFrame) -> DataFrame:
    """Documents and parsed documents by company, type and fiscal year."""
    ready = F.when(F.col("status").isin("parsed", "extracted"), F.col("doc_id"))
    return filings.groupBy("company_id", "doc_type", fiscal_year(F.col("fiscal_year")).alias("fiscal_year")).agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct(ready).alias("n_parsed"))


def statistics_texts(records: DataFrame, filings: DataFrame) -> DataFrame:
    """(topic, text): boards, subsidiaries and coverage of the accepted records as sentences with their basis."""
    r = with_filing(accepted(records), filings).withColumn("fy", F.coalesce("filing_year", F.lit("")))
    field = lambda c: F.trim(F.get_json_object("payload_json", f"$.{c}"))
    count = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))
    people = r.where("record_type = 'directors' and company_id is not null").select("company_id", "fy", field("person_name").alias("n"), F.coalesce(F.get_json_object("payload_json", "$.is_independent") == "true", F.lit(False)).alias("i")).where("n <> ''")
    people = people.groupBy("company_id", "fy", "n").agg(F.max("i").alias("i")).groupBy("company_id", "fy").agg(F.count(F.lit(1)).alias("k"), F.count_if("i").alias("i"))
    boards = people.select(F.lit("DIRECTOR_OF").alias("topic"), F.concat("company_id", F.lit(" had "), count(F.col("k"), "director", "directors"), F.lit(" on record in "), "fy", F.lit(", of whom "), F.col("i").cast("string"), F.lit(" are independent.")).alias("text"))
    subs = r.where("record_type = 'subsidiaries' and company_id is not null").select("company_id", "fy", field("subsidiary_name").alias("n")).where("n <> ''").groupBy("company_id", "fy").agg(F.count_distinct("n").alias("k"))
    held = subs.select(F.lit("SUBSIDIARY_OF").alias("topic"), F.concat("company_id", F.lit(" listed "), count(F.col("k"), "subsidiary", "subsidiaries"), F.lit(" in "), "fy", F.lit(".")).alias("text"))
    docs = filings.agg(F.count_distinct("doc_id").alias("d"))
    whole = r.agg(F.count_distinct("record_id").alias("r"), F.count_distinct("company_id").alias("c"), F.count_distinct("filing_year").alias("y"))
    cover = whole.crossJoin(docs).select(F.lit("COVERAGE").alias("topic"), F.concat(F.lit("The dataset has "), F.col("d").cast("string"), F.lit(" documents covering "), F.col("c").cast("string"), F.lit(" companies and "), F.col("y").cast("string"), F.lit(" fiscal years.")).alias("text"))  # one row each
    basis = F.broadcast(whole.select(F.concat(F.lit(" [computed from "), F.col("r").cast("string"), F.lit(" accepted records]")).alias("basis")))
    return boards.unionByName(held).unionByName(cover).crossJoin(basis).select("topic", F.concat("text", "basis").alias("text"))


def store_counts(records: DataFrame, filings: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counts of the store, each a map-side aggregate."""
    one = filings.agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct(F.when(F.col("status").isin("parsed", "extracted"), F.col("doc_id"))).alias("n_parsed"))
    two = chunks.agg(F.count_distinct("chunk_id").alias("n_chunks"))
    three = records.agg(F.count_distinct("record_id").alias("n_records"))
    four = entities.agg(F.count_distinct("entity_id").alias("n_entities"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)

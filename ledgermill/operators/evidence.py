"""Evidence: grounding of quotes, citation scores, scoring of facts and views of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.text import normalize_ascii
from ledgermill.operators.documents import page_texts, phrase_mentions


def grounded_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_id, page, found_on): the page that has the evidence's quote: the stated one, else the one before, else the one after.

    found_on is null where none of the three has it or the quote is shorter than eight characters. The three places
    become three keys of an equi-join, so records meet only pages of their own document.
    """
    ev = "struct<doc_id:string,page:int,quote:string>"
    e = records.select("record_id", F.from_json(F.get_json_object("payload_json", "$.evidence"), ev).alias("e")).where("e.page is not null").select(
        "record_id", F.col("e.doc_id").alias("doc_id"), F.col("e.page").alias("page"), normalize_ascii(F.col("e.quote")).alias("quote")).distinct()
    tries = e.select("*", F.posexplode(F.array(F.col("page"), F.col("page") - 1, F.col("page") + 1)).alias("turn", "page_no"))
    p = page_texts(pages).select("doc_id", "page_no", normalize_ascii(F.col("text")).alias("norm"))
    hit = F.coalesce((F.length("quote") >= 8) & F.col("norm").contains(F.col("quote")), F.lit(False))
    return tries.join(p, ["doc_id", "page_no"], "left").groupBy("record_id", "page").agg(F.min_by("page_no", F.when(hit, F.col("turn"))).alias("p"), F.max(hit).alias("ok")).select(
        "record_id", "page", F.when(F.col("ok"), F.col("p")).alias("found_on"))


def name_variants(name: Column) -> Column:
    """Array of the ways a company is named: without Limited, without The and Company, its first two of three or more words, & as and."""
    core = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(limited|ltd\.?)\b", ""), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(core, "^the ", ""), " company$", ""))
    words = F.split(F.trim(F.replace(bare, F.lit("&"), F.lit(" "))), r"\s+")
    short = F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 2), " "))
    some = F.filter(F.array(core, bare, short), lambda x: x.isNotNull())
    return F.filter(F.array_distinct(F.concat(some, F.transform(some, lambda x: F.replace(x, F.lit("&"), F.lit("and"))))), lambda x: x != "")


def companies_in_questions(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, company_id) of questions that name exactly one of companies (entity_id, name), word by word, by a variant of its name or its id."""
    ways = F.concat(name_variants(F.col("name")), F.array(F.lower(F.expr("substring(entity_id, 3)"))))
    names = companies.select("entity_id", F.explode(ways).alias("canonical_name"))
    hits = phrase_mentions(questions.select(F.col("qid").alias("chunk_id"), F.col("question").alias("text")), names, 1)
    return hits.groupBy(F.col("chunk_id").alias("qid")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("company_id")).where("n = 1").drop("n")


def recall_of(gold: Column, cited: Column) -> Column:
    """Share of distinct gold items that are cited; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, cited)) / F.size(F.array_distinct(gold)))


def precision_of(gold: Column, cited: Column) -> Column:
    return F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, gold)) / F.size(F.array_distinct(cited)))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of equal strings: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def pending_reviews(records: DataFrame, filings: DataFrame, limit: int = 50) -> DataFrame:
    """The newest records in review with their filing: a work list of `limit` rows."""
    f = filings.groupBy("doc_id").agg(F.max("company_id").alias("company_id"))
    r = records.where("status = 'review'").groupBy("record_id", "doc_id", "record_type").agg(F.max("loaded_at").alias("loaded_at"))
    return r.join(f, "doc_id", "left").orderBy(F.desc("loaded_at"), "record_id").limit(limit).select("record_id", "record_type", "company_id")


def repeated_calls(log: DataFrame, request: str, call: str, order: list[str]) -> DataFrame:
    """Calls that a request has made before, by order."""
    w = Window.partitionBy(request, call).orderBy(*order)
    return log.withColumn("nth", F.row_number().over(w)).where("nth > 1")

"""Resolution of mentions by blocking, scoring and canonical naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.fuzzy import sorted_ratio_udf
from ledgermill.functions.text import initials, norm_company, norm_person, surname_key
from ledgermill.operators.skew import pairs_in_groups


def official_id(kind: Column, ids: Column) -> Column:
    """P:din, C:company_id or C:cin, A:frn; null without a number or with zeros only."""
    def good(k: str) -> Column:
        v = F.try_element_at(ids, F.lit(k))
        return F.when((v != "") & ~v.rlike("^0+$"), v)

    return F.when(kind == "person", F.concat(F.lit("P:"), good("din"))).when(kind == "company", F.concat(F.lit("C:"), F.coalesce(good("company_id"), good("cin")))).when(
        kind == "audit_firm", F.concat(F.lit("A:"), good("frn")))


def fallback_id(kind: Column, name: Column) -> Column:
    prefix = F.when(kind == "person", "P:x").when(kind == "audit_firm", "A:x").otherwise("C:x")
    return F.concat(prefix, F.left(F.sha2(name, 256), F.lit(8)))


def block_key(kind: Column, name: Column) -> Column:
    """Names are compared within a key: persons of one surname, companies of the same first two words, firms of the same first.

    A person's second key, surname and reporting company, only repeats pairs of the first.
    """
    words = F.split(name, " ")
    return F.when(kind == "person", F.concat(F.lit("person:"), surname_key(name))).when(kind == "company", F.concat(F.lit("company:"), F.array_join(F.slice(words, 1, 2), " "))).when(
        kind == "audit_firm", F.concat(F.lit("audit_firm:"), F.element_at(words, 1))).otherwise("unknown")


def initials_fit(a: Column, b: Column) -> Column:
    """True if the letters of one name's initials are all among the other's."""
    x, y = (F.array_distinct(F.split(initials(c), "")) for c in (a, b))
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def candidate_pairs(mentions: DataFrame, low: float = 80.0, auto: float = 95.0) -> DataFrame:
    """(kind, name_a, id_a, name_b, id_b, score, method): pairs of classes of mentions that match within a block.

    A class is a kind, normalised name and official id (key=value, or ''); mentions of one class match each other and
    are not listed. Classes with different values of one id never match. Equal names are exact_name; else the
    similarity of the sorted words decides, 0 for persons whose initials do not fit: fuzzy from auto on, review_queue
    from low on. Blocks are made in parts, so no task holds a large block's square, and names whose lengths
    rule out low are not scored.
    """
    official = F.array_join(F.transform(F.array_sort(F.map_entries("ids")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    n = mentions.where("norm_name is not null and norm_name <> ''").select("kind", F.col("norm_name").alias("name"), F.coalesce(official, F.lit("")).alias("id")).distinct()
    p = pairs_in_groups(n.withColumn("block", block_key(F.col("kind"), F.col("name"))), "block", ["kind", "name", "id"])
    la, lb = F.length("name_a"), F.length("name_b")
    conflict = (F.col("id_a") != "") & (F.col("id_b") != "") & (F.substring_index("id_a", "=", 1) == F.substring_index("id_b", "=", 1)) & (F.col("id_a") != F.col("id_b"))
    p = p.where((F.col("kind_a") == F.col("kind_b")) & ~conflict & (F.least(la, lb) * 200.0 >= low * (la + lb)))
    same = F.col("name_a") == F.col("name_b")
    p = p.where(same | (F.col("kind_a") != "person") | initials_fit(F.col("name_a"), F.col("name_b")))
    s = p.withColumn("score", F.when(same, 100.0).otherwise(F.round(sorted_ratio_udf("name_a", "name_b"), 4))).where(F.col("score") >= low)
    return s.select(F.col("kind_a").alias("kind"), "name_a", "id_a", "name_b", "id_b", "score", F.when(same, "exact_name").when(F.col("score") >= auto, "fuzzy").otherwise("review_queue").alias("method"))


def canonical_names(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, aliases): most frequent raw name, then the longest, then the first by bytes; aliases sorted, joined by |."""
    c = mentions.where("raw_name is not null").join(links, "mention_id").groupBy("entity_id", "raw_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("entity_id").agg(
        F.min_by("raw_name", F.struct(-F.col("n"), -F.length("raw_name"), "raw_name")).alias("canonical_name"), F.array_join(F.sort_array(F.collect_set("raw_name")), "|").alias("aliases"))


#: Endings and words that make a counterparty a company.
COMPANY_ENDINGS = ["limited", "ltd", "private", "pvt", "llp", "trust", "inc", "co", "corporation"]


def is_company_name(c: Column) -> Column:
    """True if a word of the name, but the first, begins with one of COMPANY_ENDINGS or the name ends in one."""
    words = "|".join(COMPANY_ENDINGS)
    return F.lower(c).rlike(rf" (?:{words})|(?:{words})$")


def build_mentions(records: DataFrame, filings: DataFrame, company_names: DataFrame) -> DataFrame:
    """(mention_id, kind, raw_name, norm_name, ids, context_company_id, record_id) of accepted records.

    Each director, transaction, auditor and subsidiary record gives its reporting company (context_company, by its
    name in company_names (company_id, name), else its id) and the one named in it, if any.
    """
    from ledgermill.operators.records import accepted, last_deliveries, one_filing

    fields = "person_name string, din string, counterparty_name string, firm_name string, firm_registration_no string, subsidiary_name string"
    acc = accepted(last_deliveries(records)).where(F.col("record_type").isin("directors", "rpt", "auditor", "subsidiaries"))
    r = acc.select("record_id", "doc_id", F.col("record_type").alias("t"), F.from_json("payload_json", fields).alias("p")).join(one_filing(filings).select("doc_id", "company_id"), "doc_id").join(company_names.select("company_id", "name"), "company_id", "left")
    t, none = F.col("t"), F.lit(None).cast("string")
    raw = F.when(t == "directors", F.col("p.person_name")).when(t == "rpt", F.col("p.counterparty_name")).when(t == "auditor", F.col("p.firm_name")).otherwise(F.col("p.subsidiary_name"))
    kind = F.when(t == "directors", "person").when(t == "auditor", "audit_firm").when((t == "rpt") & ~is_company_name(raw), "person").otherwise("company")
    part = F.when(t == "directors", "person").when(t == "rpt", "counterparty").when(t == "auditor", "audit_firm").otherwise("subsidiary")
    key = F.when(t == "directors", "din").when(t == "auditor", "frn")
    value = F.nullif(F.when(t == "directors", F.col("p.din")).when(t == "auditor", F.col("p.firm_registration_no")), F.lit(""))
    own = F.struct(part.alias("part"), kind.alias("kind"), raw.alias("raw_name"), F.when(value.isNotNull(), key).alias("id_key"), value.alias("id_value"))
    company = F.struct(F.lit("context_company").alias("part"), F.lit("company").alias("kind"), F.coalesce("name", "company_id").alias("raw_name"), F.lit("company_id").alias("id_key"), F.col("company_id").alias("id_value"))
    m = r.select("record_id", "company_id", F.explode(F.array(own, company)).alias("m")).select("record_id", "company_id", "m.*").where("raw_name is not null and raw_name <> ''")
    norm = F.when(F.col("kind") == "person", norm_person(F.col("raw_name"))).otherwise(norm_company(F.col("raw_name")))
    ids = F.when(F.col("id_key").isNotNull(), F.create_map("id_key", "id_value")).otherwise(F.create_map().cast("map<string,string>"))
    return m.select(F.concat_ws(":", "record_id", "part").alias("mention_id"), "kind", "raw_name", norm.alias("norm_name"), ids.alias("ids"), F.col("company_id").alias("context_company_id"), "record_id")

"""Typed extraction records: decoding, validation, statistics and the property graph made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EVIDENCE = "evidence struct<doc_id:string,page:int,quote:string>"
PAYLOAD = {
    "directors": f"person_name string, din string, company_name string, role string, is_independent boolean, appointed_on string, ceased_on string, fiscal_year string, {EVIDENCE}",
    "shareholding": f"holder_name string, holder_kind string, company_name string, pct_holding double, pct_pledged_of_holding double, is_promoter_group boolean, as_of string, {EVIDENCE}",
    "rpt": f"reporting_company string, counterparty_name string, relationship string, nature string, amount_inr double, amount_raw string, fiscal_year string, {EVIDENCE}",
    "auditor": f"company_name string, firm_name string, firm_registration_no string, fiscal_year string, {EVIDENCE}",
    "subsidiaries": f"parent_company string, subsidiary_name string, pct_held double, as_of string, {EVIDENCE}",
    "regulatory": f"order_id string, regulator string, order_date string, action_type string, named_entities array<string>, summary string, {EVIDENCE}",
}


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("accepted", "fixed"))


def latest_delivery(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last by order (keep-last upsert); ties by all columns, so the result is determined."""
    rest = [c for c in df.columns if c not in (key, *order)]
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order], *[F.col(c).cast("string").desc_nulls_last() for c in rest])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def decoded(records: DataFrame, record_type: str) -> DataFrame:
    """Records of one type with the payload's fields; malformed payloads give null fields."""
    keep = [c for c in ("record_id", "doc_id", "status", "loaded_at") if c in records.columns]
    return records.where(F.col("record_type") == record_type).select(*keep, F.from_json("payload_json", PAYLOAD[record_type]).alias("p"))


def has_provenance() -> Column:
    return F.coalesce((F.get_json_object("payload_json", "$.evidence.quote") != "") & (F.get_json_object("payload_json", "$.evidence.page").cast("int") != 0), F.lit(False))


#: Words of offices; a name of three words or fewer with one of them is an office.
ROLE_WORDS = ["chairman", "chairperson", "secretary", "director", "manager", "ceo", "cfo", "officer"]
#: The names a record of each type must have.
_NEEDED_NAMES = {
    "directors": ["person_name", "company_name"], "shareholding": ["holder_name", "company_name"], "rpt": ["counterparty_name"],
    "auditor": ["company_name"], "subsidiaries": ["parent_company", "subsidiary_name"], "regulatory": [],
}
_ALL_FIELDS = "person_name string, din string, company_name string, holder_name string, counterparty_name string, parent_company string, subsidiary_name string, pct_holding double, pct_held double, pct_pledged_of_holding double, appointed_on string, ceased_on string, fiscal_year string, amount_inr double, evidence struct<doc_id:string,page:int,quote:string>"


def validated(records: DataFrame) -> DataFrame:
    """(record_id, din, verdict, reason) of records of the six types, by the rules of their type.

    The first rule that rejects decides; of rules that ask for review the last one names the reason. A DIN that is not
    eight digits is cleared. A payload that is no JSON has no evidence and is rejected.
    """
    p = records.where(F.col("record_type").isin(*_NEEDED_NAMES)).select("record_id", "record_type", F.from_json("payload_json", _ALL_FIELDS).alias("p")).select("record_id", "record_type", "p.*")
    t = F.col("record_type")
    blank = [(t == k) & F.coalesce(F.trim(c), F.lit("")).eqNullSafe("") for k, names in _NEEDED_NAMES.items() for c in names]
    no_name = blank[0]
    for x in blank[1:]:
        no_name = no_name | x
    words = F.regexp_extract_all(F.lower("person_name"), F.lit("([a-z]+)"), F.lit(1))
    pct = F.coalesce("pct_holding", "pct_held")
    appointed, ceased = (F.col(c).try_cast("date") for c in ("appointed_on", "ceased_on"))
    start = F.nullif(F.regexp_extract("fiscal_year", r"(20\d{2})", 1), F.lit("")).cast("int")
    far = lambda d: F.coalesce(F.abs(F.year(d) - start) > 2, F.lit(False))
    reject = (F.when(F.col("evidence").isNull(), "missing_evidence").when(no_name, "empty_name")
              .when((t == "directors") & (F.size(words) <= 3) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in ROLE_WORDS])), "name_is_role")
              .when((pct < 0) | (pct > 100), "pct_out_of_range").when(F.col("amount_inr") < 0, "amount_negative"))
    review = (F.when(F.col("amount_inr") > 1e12, "amount_outlier").when((t == "directors") & (far(appointed) | far(ceased)), "date_implausible")
              .when(appointed > ceased, "date_order_invalid").when((F.col("pct_pledged_of_holding") < 0) | (F.col("pct_pledged_of_holding") > 100), "pledge_out_of_range"))
    return p.select(
        "record_id", F.when(F.col("din").rlike(r"^\d{8}$"), F.col("din")).alias("din"),
        F.when(reject.isNotNull(), "rejected").when(review.isNotNull(), "review").otherwise("accepted").alias("verdict"), F.coalesce(reject, review, F.lit("")).alias("reason"))


def last_deliveries(records: DataFrame) -> DataFrame:
    """One row a record_id, the one loaded last, by a map-side aggregate; ties go to the greatest of the other columns."""
    cols = ["loaded_at", "status", "doc_id", "record_type", "payload_json"]
    return records.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct(*cols)).alias("r")).select("record_id", "r.*")


def one_filing(filings: DataFrame) -> DataFrame:
    return filings.where("doc_id is not null").groupBy("doc_id").agg(F.max("company_id").alias("company_id"), F.max("fiscal_year").alias("filing_year"))


def latest_links(merge_log: DataFrame) -> DataFrame:
    """(mention_id, entity_id): the latest resolution of each mention, by logged_at, then log_id. Map-side, so no mention is hot."""
    last = F.max(F.struct("logged_at", "log_id", "entity_id"))
    return merge_log.where("mention_id is not null").groupBy("mention_id").agg(last["entity_id"].alias("entity_id")).where("entity_id is not null")


#: Kind of an entity -> vertex type.
VERTEX_TYPES = {"company": "Company", "person": "Person", "audit_firm": "AuditFirm"}
#: Reverse relation -> relation.
REVERSE_RELATIONS = {
    "HAS_DIRECTOR": "DIRECTOR_OF", "HAS_PARTY": "PARTY_TO", "HAS_SUBSIDIARY": "SUBSIDIARY_OF", "AUDITS": "AUDITED_BY", "HELD_BY": "HOLDS_STAKE",
    "NAMES": "NAMED_IN", "SECTOR_OF": "IN_SECTOR",
}
_EDGE_FIELDS = "role string, is_independent boolean, appointed_on string, ceased_on string, fiscal_year string, amount_inr double, nature string, relationship string, pct_held double, as_of string, evidence struct<page:int,quote:string>"


def record_ends(merge_log: DataFrame) -> DataFrame:
    """(record_id, person, context_company, counterparty, audit_firm, subsidiary): the resolved ends of each record, in one pass."""
    links = latest_links(merge_log).select(F.substring_index("mention_id", ":", 1).alias("record_id"), F.element_at(F.split("mention_id", ":"), 2).alias("part"), "entity_id")
    parts = ("person", "context_company", "counterparty", "audit_firm", "subsidiary")
    return links.groupBy("record_id").agg(*[F.max(F.when(F.col("part") == p, F.col("entity_id"))).alias(p) for p in parts])


def graph_edges(records: DataFrame, merge_log: DataFrame, filings: DataFrame, entities: DataFrame) -> DataFrame:
    """All fact edges of the property graph as one tall table; every input is read once.

    edge_id, rel, src_id, src_type, dst_id, dst_type, role (of a director, or side of a party), independent, start_date,
    end_date, fiscal_year, pct_held, as_of, doc_id, page, quote and, for PARTY_TO, amount_inr, nature, relationship of the
    transaction. A transaction gives two edges to its vertex. Both ends of a record must be resolved; a counterparty that
    is an audit firm gives no edge. Missing years come from the filing.
    """
    acc = accepted(last_deliveries(records)).where(F.col("record_type").isin("directors", "rpt", "auditor", "subsidiaries"))
    r = acc.select("record_id", "record_type", "doc_id", F.from_json("payload_json", _EDGE_FIELDS).alias("p")).join(one_filing(filings), "doc_id").join(record_ends(merge_log), "record_id")
    # a counterparty's kind; unknown entities count as companies
    kinds = entities.where("entity_id is not null").groupBy(F.col("entity_id").alias("counterparty")).agg(F.max("kind").alias("party_kind"))
    r = r.join(kinds, "counterparty", "left")
    none = F.lit(None).cast("string")
    txn = F.left(F.sha2("record_id", 256), F.lit(16))

    def edge(rel: str, src: str, src_type, dst, dst_type: str, role=none, name: str = "") -> F.Column:
        key = F.left(F.sha2(F.concat(F.col("record_id"), F.lit(f":{name or rel}")), 256), F.lit(16))
        return F.struct(key.alias("edge_id"), F.lit(rel).alias("rel"), F.col(src).alias("src_id"), src_type.alias("src_type"), dst.alias("dst_id"), F.lit(dst_type).alias("dst_type"), role.alias("role"))

    company, person = F.lit("Company"), F.lit("Person")
    party = F.when(F.col("party_kind") == "person", person).when(F.col("party_kind") == "audit_firm", none).otherwise(company)
    t = F.col("record_type")
    ctx = F.col("context_company")
    found = (F.when(t == "directors", F.array(edge("DIRECTOR_OF", "person", person, ctx, "Company", F.col("p.role"))))
             .when(t == "auditor", F.array(edge("AUDITED_BY", "context_company", company, F.col("audit_firm"), "AuditFirm")))
             .when(t == "subsidiaries", F.array(edge("SUBSIDIARY_OF", "subsidiary", company, ctx, "Company")))
             .when(F.col("counterparty").isNotNull() & ctx.isNotNull(), F.array(
                 edge("PARTY_TO", "context_company", company, txn, "RelatedPartyTxn", F.lit("reporting"), "PARTY_TO:reporting"),
                 edge("PARTY_TO", "counterparty", party, txn, "RelatedPartyTxn", F.lit("counterparty"), "PARTY_TO:counterparty"))))
    year = F.when(t != "subsidiaries", F.coalesce(F.nullif(F.col("p.fiscal_year"), F.lit("")), "filing_year", F.lit(""))).otherwise(F.lit(""))
    e = r.withColumn("year", year).select("record_type", "doc_id", "p", "year", F.explode(found).alias("e")).where("e.src_id is not null and e.dst_id is not null and e.src_type is not null")
    only = lambda kind, c: F.when(F.col("record_type") == kind, c)
    return e.select(
        "e.*", only("directors", F.coalesce("p.is_independent", F.lit(False))).alias("independent"), only("directors", F.coalesce("p.appointed_on", F.lit(""))).alias("start_date"),
        only("directors", F.coalesce("p.ceased_on", F.lit(""))).alias("end_date"), F.col("year").alias("fiscal_year"), only("subsidiaries", F.coalesce("p.pct_held", F.lit(0.0))).alias("pct_held"),
        only("subsidiaries", F.coalesce("p.as_of", F.lit(""))).alias("as_of"), "doc_id", F.coalesce("p.evidence.page", F.lit(0)).alias("page"), F.coalesce("p.evidence.quote", F.lit("")).alias("quote"),
        only("rpt", F.coalesce("p.amount_inr", F.lit(0.0))).alias("amount_inr"), only("rpt", F.coalesce("p.nature", F.lit(""))).alias("nature"), only("rpt", F.coalesce("p.relationship", F.lit(""))).alias("relationship"))


def forward_edges(raw: DataFrame) -> DataFrame:
    """Raw edges (rel, src_id, src_type, dst_id, dst_type, edge_id) read forward: reverse relations are turned round, other
    relations and edges without both ends left out, missing ids made from the ends, repeats kept once."""
    names = F.create_map(*[F.lit(x) for kv in REVERSE_RELATIONS.items() for x in kv])
    back = F.element_at(names, F.col("rel"))
    turned = [F.when(back.isNotNull(), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("src_id", "dst_id"), ("src_type", "dst_type"), ("dst_id", "src_id"), ("dst_type", "src_type"))]
    rest = [c for c in raw.columns if c not in ("rel", "src_id", "src_type", "dst_id", "dst_type", "edge_id")]
    e = raw.select("edge_id", F.coalesce(back, "rel").alias("rel"), *turned, *rest).where(F.col("rel").isin(*sorted(REVERSE_RELATIONS.values())) & (F.col("src_id") != "") & (F.col("dst_id") != ""))
    made = F.left(F.sha2(F.concat_ws(":", "rel", "src_id", "dst_id"), 256), F.lit(16))
    return e.withColumn("edge_id", F.coalesce(F.nullif(F.col("edge_id"), F.lit("")), made)).dropDuplicates(["edge_id"])


def vertex_type(entity_id) -> F.Column:
    """Vertex type of an id by its prefix; null for other ids."""
    return F.when(entity_id.startswith("C:"), "Company").when(entity_id.startswith("P:"), "Person").when(entity_id.startswith("A:"), "AuditFirm")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """HAS_CHUNK: (src_id document, dst_id chunk), distinct."""
    return chunks.where("doc_id is not null and chunk_id is not null").select(F.lit("HAS_CHUNK").alias("rel"), F.col("doc_id").alias("src_id"), F.col("chunk_id").alias("dst_id")).distinct()

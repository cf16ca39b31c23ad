"""The context of an answer: facts ranked and written as text, budgets, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.fuzzy import partial_ratio
from ledgermill.functions.text import crore_text, estimate_tokens
from ledgermill.operators.retrieval import fit_budget

#: Weights of a fact's score.
TOUCHES, ASKED, YEAR, FIRST_HOP, NAMED, IN_DATASET = 3.0, 2.0, 1.5, 1.0, 1.0, 0.5
MIN_NAME = 4
#: Fixed value: facts of a question.
MAX_FACTS = 40


def fact_scores(facts: DataFrame, linked: DataFrame, question: Column, relations: list[str], years: list[str], labels: DataFrame, dataset: DataFrame) -> DataFrame:
    """facts (edge_id, rel, src_id, dst_id, fiscal_year, hop, ...) with score: an end is linked (id), the relation or year is
    asked for, first hop, an end's normalised name (entity_id, norm) of MIN_NAME letters or more stands in the normalised
    question, an end is a company of the data set (id)."""
    def marks(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        m = df.select(F.col(key).alias("k")).distinct()
        return m.select(F.col("k").alias("src_id"), F.lit(True).alias(f"s_{name}")), m.select(F.col("k").alias("dst_id"), F.lit(True).alias(f"d_{name}"))

    named = labels.where(F.length("norm") >= MIN_NAME).where(question.contains(F.col("norm")))
    out = facts
    for df, key, name in ((linked, "id", "linked"), (named, "entity_id", "named"), (dataset, "id", "data")):
        for side in marks(df, key, name):
            out = out.join(side, [c for c in side.columns if c.endswith("_id")], "left")
    has = lambda n: F.coalesce(F.col(f"s_{n}") | F.col(f"d_{n}"), F.col(f"s_{n}"), F.col(f"d_{n}"), F.lit(False))
    parts = [(has("linked"), TOUCHES), (F.col("rel").isin(*relations), ASKED), (F.col("fiscal_year").isin(*years), YEAR), (F.col("hop") == 1, FIRST_HOP), (has("named"), NAMED), (has("data"), IN_DATASET)]
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0], parts[0][1]).otherwise(0.0))
    return out.withColumn("score", score).select(*facts.columns, "score")


def _unit() -> Column:
    return F.when(F.col("rel") == "PARTY_TO", F.col("dst_id")).otherwise(F.col("edge_id"))


def seed_units(near: DataFrame, ends: Column, max_facts: int = MAX_FACTS) -> DataFrame:
    """(seed, first, size, unit_rel, unit_year, edges, holders, of_year, of_all): units of near (seed, edge_id, rel, dst_id, fiscal_year, ...)
    without those that ranked_units can't take, whatever is asked; holders: the ends of its edges; of_year, of_all: its place, by
    first, among the seed's units of its relation and size, of its year and of all years.

    For scores that depend on a unit's relation and year alone: the max_facts first of one relation, size and year come
    before all others. A unit's edges share relation and year, and all of them come with each of its seeds.
    """
    rest = [c for c in near.columns if c != "seed"]
    units = near.withColumn("unit", _unit()).where("unit is not null").groupBy("seed", "unit").agg(
        F.min("edge_id").alias("first"), F.count(F.lit(1)).cast("int").alias("size"), F.first("rel").alias("unit_rel"), F.first("fiscal_year").alias("unit_year"),
        F.collect_list(F.struct(*rest)).alias("edges"), F.array_distinct(F.flatten(F.collect_list(ends))).alias("holders"))
    w = Window.partitionBy("seed", "unit_rel", "size")
    able = units.drop("unit").withColumn("of_year", F.row_number().over(w.partitionBy("seed", "unit_rel", "size", "unit_year").orderBy("first"))).where(F.col("of_year") <= max_facts)
    return able.withColumn("of_all", F.row_number().over(w.orderBy("first")))


def takeable(year: Column, seeds: Column, max_facts: int = MAX_FACTS) -> Column:
    """Whether a question with this year (or null) can take a unit of seed_units by its seed; of several seeds that hold it, by the least."""
    place = (F.col("of_all") <= max_facts) | F.coalesce(F.col("unit_year") == year, F.lit(False))
    return place & (F.col("seed") == F.array_min(F.array_intersect(F.col("holders"), seeds)))


def ranked_facts(scored: DataFrame, requested: list[str], max_facts: int = MAX_FACTS, min_per_relation: int = 3, group: str = "query_id") -> DataFrame:
    """scored (group, edge_id, rel, dst_id, score) capped at max_facts a group, with rank: best first, a transaction's edges as one unit, by ranked_units."""
    rest = [c for c in scored.columns if c != group]
    u = scored.dropDuplicates([group, "edge_id"]).withColumn("unit", _unit()).where("unit is not null")
    units = u.groupBy(group, "unit").agg((-F.max("score")).alias("low"), F.min("edge_id").alias("first"), F.count(F.lit(1)).cast("int").alias("size"), F.first("rel").alias("unit_rel"), F.collect_list(F.struct(*rest)).alias("edges"))
    return ranked_units(units, requested, max_facts, min_per_relation, group).select(*scored.columns, "rank")


def ranked_units(units: DataFrame, requested: list[str], max_facts: int = MAX_FACTS, min_per_relation: int = 3, group: str = "query_id") -> DataFrame:
    """(group, columns of edges, rank): edges of units (group, low, first, size, unit_rel, edges) capped at max_facts a group, the least low and first first.

    Of every requested relation the best min_per_relation units come first, then the best others, each if it still
    fits; an ordered fold over a group's units, of which only size, relation and score take part. What the fold takes of
    one relation and size are the best of them, so that max_facts of each are all it can take, and no others reach it.
    """
    able = units.withColumn("k", F.row_number().over(Window.partitionBy(group, "unit_rel", "size").orderBy("low", "first"))).where(F.col("k") <= max_facts)
    packed = able.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("low", "first", "unit_rel", "size", "edges"))).alias("xs"))

    @F.pandas_udf("array<int>")
    def choose(rels: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(rs, ns) -> list[int]:
            taken, used = set(), 0
            for rel in [*sorted(requested), None]:
                reserved = 0
                for i, (r, n) in enumerate(zip(rs, ns)):
                    if rel is not None and reserved >= min_per_relation:
                        break
                    if i not in taken and (rel is None or r == rel) and used + n <= max_facts:
                        taken.add(i)
                        used, reserved = used + int(n), reserved + 1
            return sorted(taken)

        return pd.Series([one(r, n) for r, n in zip(rels, sizes)])

    kept = packed.select(group, F.transform(choose("xs.unit_rel", "xs.size"), lambda i: F.get(F.col("xs.edges"), i)).alias("kept"))
    out = kept.select(group, F.posexplode("kept").alias("place", "es")).select(group, "place", F.explode("es").alias("x")).select(group, "place", "x.*")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("place", "edge_id"))).drop("place")


def split_budget(primary: DataFrame, secondary: DataFrame, total: int, share: float, group: str = "query_id") -> DataFrame:
    """Items (group, rank, tokens, ref_id) of both lists within total: primary up to its share, secondary the rest, primary's unused share too."""
    kept = fit_budget(primary, group, "rank", "tokens", int(total * share)).withColumn("part", F.lit("primary"))
    used = kept.groupBy(group).agg(F.sum(F.col("tokens") + 30).alias("used"))
    left = secondary.join(used, group, "left").withColumn("room", F.lit(total) - F.coalesce("used", F.lit(0))).drop("used")
    packed = left.groupBy(group, "room").agg(F.sort_array(F.collect_list(F.struct("rank", "tokens", "ref_id"))).alias("xs"))
    none = F.expr("filter(xs, x -> false)")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("kept"))
    step = F.aggregate("xs", start, lambda a, x: F.when(a["used"] + x["tokens"] + 30 <= F.col("room"), F.struct((a["used"] + x["tokens"] + 30).cast("bigint").alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    second = packed.select(group, F.explode(step["kept"]).alias("x")).select(group, "x.*", F.lit("secondary").alias("part"))
    both = kept.select(group, "rank", "tokens", "ref_id", "part").unionByName(second.select(group, "rank", "tokens", "ref_id", "part"))
    w = Window.partitionBy(group).orderBy("part", "rank")
    return both.withColumn("label", F.concat(F.lit("E"), F.row_number().over(w).cast("string")))


def _listed(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "; ")


def fact_texts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(ref_id, rel, text, doc_id, page, fiscal_year): one evidence text a fact, both parties of a transaction in one.

    Ends carry the names of labels (entity_id, name), else their ids. ref_id lists a transaction's edges by comma.
    """
    src = labels.select(F.col("entity_id").alias("src_id"), F.col("name").alias("src_name"))
    dst = labels.select(F.col("entity_id").alias("dst_id"), F.col("name").alias("dst_name"))
    e = edges.join(src, "src_id", "left").join(dst, "dst_id", "left")
    end = lambda t, n, i: F.concat(F.col(t), F.lit(": "), F.coalesce(n, i))
    pct = lambda c: F.when(F.col(c) > 0, F.concat(F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", ""), F.lit("%")))
    dated = F.when((F.coalesce("start_date", F.lit("")) != "") | (F.coalesce("end_date", F.lit("")) != ""), F.concat(F.coalesce(F.nullif("start_date", F.lit("")), F.lit("?")), F.lit(" to "), F.coalesce(F.nullif("end_date", F.lit("")), F.lit("present"))))
    label = (F.when(F.col("rel") == "DIRECTOR_OF", _listed(F.col("role"), F.when(F.col("independent"), F.lit("independent")), F.col("fiscal_year"), dated))
             .when(F.col("rel") == "AUDITED_BY", F.col("fiscal_year")).otherwise(_listed(F.concat(pct("pct_held"), F.lit(" held")), F.concat(F.lit("as of "), F.nullif("as_of", F.lit(""))))))
    source = F.when(F.coalesce("doc_id", F.lit("")) == "", "  source: not recorded for this relation").otherwise(
        F.concat(F.lit("  source: doc "), F.left("doc_id", F.lit(12)), F.lit("…, p."), F.col("page").cast("string"), F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit(' | quote: "'), "quote", F.lit('"'))).otherwise("")))
    e = e.withColumn("source", source).withColumn("a", end("src_type", "src_name", "src_id"))
    plain = e.where("rel <> 'PARTY_TO'").select(
        F.col("edge_id").alias("ref_id"), "rel", F.concat("a", F.lit(" —["), "rel", F.when(label != "", F.concat(F.lit(": "), label)).otherwise(""), F.lit("]→ "), end("dst_type", "dst_name", "dst_id"), F.lit("\n"), "source").alias("text"), "doc_id", "page", "fiscal_year")
    side = lambda s: F.max(F.when(F.col("role") == s, F.col("a")))
    t = e.where("rel = 'PARTY_TO'").groupBy("dst_id").agg(
        F.array_join(F.sort_array(F.collect_set("edge_id")), ",").alias("ref_id"), side("reporting").alias("l"), side("counterparty").alias("r"), F.min("a").alias("any"), *[F.max(c).alias(c) for c in ("fiscal_year", "nature", "amount_inr", "relationship", "source", "doc_id", "page")])
    detail = _listed(F.col("nature"), crore_text(F.col("amount_inr")))
    year = F.when(F.coalesce("fiscal_year", F.lit("")) != "", F.concat(F.lit(" "), "fiscal_year")).otherwise("")
    txn = F.concat(F.coalesce("l", "any"), F.lit(" —[RELATED-PARTY TXN"), year, F.lit(": "), detail, F.lit("]→ "), F.coalesce("r", F.lit("(counterparty not retrieved)")),
                   F.when(F.coalesce("relationship", F.lit("")) != "", F.concat(F.lit(" (relationship: "), "relationship", F.lit(")"))).otherwise(""), F.lit("\n"), "source")
    return plain.unionByName(t.select("ref_id", F.lit("PARTY_TO").alias("rel"), txn.alias("text"), "doc_id", "page", "fiscal_year"))


def resolved_citations(citations: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, n, label, status, doc_id, page) of citations (query_id, n, label, quote) against labelled evidence (query_id,
    label, text, doc_id, page_start, page_end) and pages (doc_id, page_no, text).

    status: unknown_label where the evidence has no such label; quote_not_found where its text neither holds the quote nor
    is alike by a partial ratio of 95; else ok. page: the first of the evidence's pages that holds the quote, else its first.
    """
    @F.pandas_udf("boolean")
    def alike(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([bool(a) and b is not None and (a in b or partial_ratio(a, b) >= 95) for a, b in zip(q, t)], dtype=bool)

    c = citations.join(evidence, ["query_id", "label"], "left")
    tries = c.where("doc_id is not null").select("query_id", "n", "quote", "doc_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_no"))
    hit = tries.join(pages.select("doc_id", "page_no", F.col("text").alias("page_text")), ["doc_id", "page_no"]).where((F.col("quote") != "") & F.col("page_text").contains(F.col("quote"))).groupBy("query_id", "n").agg(F.min("page_no").alias("page"))
    out = c.join(hit, ["query_id", "n"], "left")
    status = F.when(F.col("text").isNull(), "unknown_label").when(alike(F.coalesce("quote", F.lit("")), "text"), "ok").otherwise("quote_not_found")
    return out.select("query_id", "n", "label", status.alias("status"), "doc_id", F.when(F.col("text").isNotNull(), F.coalesce("page", "page_start")).alias("page"))


def prioritized(items: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """Items (group, n, tokens, ref_id, cited, recent, relevance) that fit: in order of n where all fit, else cited first, then by relevance with
    a bonus of 0.05 for recent ones, n breaking ties."""
    need = F.sum(F.col("tokens") + 30).over(Window.partitionBy(group))
    first = F.when(F.col("need") <= budget, 0.0).when(F.col("cited"), -1000.0).otherwise(-(F.coalesce("relevance", F.lit(0.0)) + F.when(F.col("recent"), 0.05).otherwise(0.0)))
    order = F.row_number().over(Window.partitionBy(group).orderBy("first", "n"))
    return fit_budget(items.withColumn("need", need).withColumn("first", first).withColumn("rank", order).select(group, "rank", "tokens", "ref_id"), group, "rank", "tokens", budget)


def statistics_pack(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """Statistics (topic, text, n) in order: coverage, wanted topics, the rest, each in the order of n, with rank."""
    first = F.when(F.col("topic") == "COVERAGE", 0).when(F.col("topic").isin(*wanted), 1).otherwise(2)
    return texts.withColumn("rank", F.row_number().over(Window.orderBy(first, "n")))  # a report of one data set


def chunk_evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, ref_id, tokens): retrieved chunks (doc_id, text) as evidence items; only the texts' lengths meet the hits."""
    return hits.join(chunks.select("doc_id", estimate_tokens(F.col("text")).alias("tokens")), "doc_id").select("query_id", "rank", F.col("doc_id").alias("ref_id"), "tokens")

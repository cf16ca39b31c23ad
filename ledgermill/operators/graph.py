"""Traversal of edge tables (edge_id, rel, src_id, dst_id, fiscal_year, ...), for all seeds or questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.session import cut_lineage


_SEEDED = ("Company", "Person", "AuditFirm")


def seeded(vertex_type: str) -> Column:
    return F.col(vertex_type).isin(*_SEEDED)


def seeded_ends() -> Column:
    """The ends of an edge that can be seeds."""
    return F.filter(F.array(F.when(seeded("src_type"), F.col("src_id")), F.when(seeded("dst_type"), F.col("dst_id"))), lambda x: x.isNotNull())


def neighbours(edges: DataFrame, seeds: DataFrame, relations: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Edges touching a seed (id) with seed and other, both directions, once a seed; other is not in excluded (id).

    Seeds are companies, persons and audit firms, so a transaction is reached only from its parties. A reached
    transaction's other party edges come along under the same seed, whatever party they name, with touches false.
    """
    e = edges if relations is None else edges.where(F.col("rel").isin(*relations))
    ends = F.array(F.struct(F.col("src_id").alias("seed"), F.col("src_type").alias("seed_type"), F.col("dst_id").alias("other")), F.struct(F.col("dst_id").alias("seed"), F.col("dst_type").alias("seed_type"), F.col("src_id").alias("other")))
    by_end = e.withColumn("x", F.explode(ends)).select(*e.columns, "x.*").where(seeded("seed_type")).drop("seed_type")
    near = by_end.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    if excluded is not None:
        near = near.join(excluded.select(F.col("id").alias("other")).distinct(), "other", "left_anti")
    near = near.withColumn("touches", F.lit(True))
    reached = near.where("rel = 'PARTY_TO'").select("seed", F.col("dst_id").alias("txn")).distinct()
    parties = e.where("rel = 'PARTY_TO'").join(reached, F.col("dst_id") == F.col("txn")).select(*e.columns, F.col("seed"), F.col("src_id").alias("other"), F.lit(False).alias("touches"))
    both = near.select(*e.columns, "seed", "other", "touches").unionByName(parties)
    return both.groupBy(*e.columns, "seed").agg(F.max_by("other", "touches").alias("other"), F.max("touches").alias("touches"))


def filter_years(edges: DataFrame, years: list[str]) -> DataFrame:
    """Edges of the years; edges without a year are kept; no years: all."""
    if not years:
        return edges
    return edges.where(F.col("fiscal_year").isNull() | (F.col("fiscal_year") == "") | F.col("fiscal_year").isin(*years))


def cap_per_seed(touching: DataFrame, fanout: int) -> DataFrame:
    """The newest `fanout` edges of each seed, by (fiscal_year, edge_id) falling; the limit is the operator's purpose.

    Party edges that touch no seed take no place; they stay where another edge of their transaction stays.
    """
    w = Window.partitionBy("seed").orderBy(F.coalesce("fiscal_year", F.lit("")).desc(), F.col("edge_id").desc())
    kept = touching.where("touches").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= fanout).drop("__k")
    txns = kept.where("rel = 'PARTY_TO'").select("dst_id", "seed").distinct()
    return kept.unionByName(touching.where("not touches").join(txns, ["dst_id", "seed"], "left_semi").select(*kept.columns))


def degrees(merge_log: DataFrame) -> DataFrame:
    return merge_log.where("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(degree: DataFrame, percentile: float = 0.99, floor: int = 25) -> DataFrame:
    """Entities whose degree is above both the percentile (linear interpolation) and the floor."""
    cut = degree.agg(F.greatest(F.percentile("degree", F.lit(percentile)), F.lit(float(floor))).alias("cut"))
    return degree.join(F.broadcast(cut), F.col("degree") > F.col("cut")).select("entity_id", "degree")


def shared_by_all(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources linked to every target (id): relational division on distinct targets."""
    n = targets.select("id").distinct().agg(F.count(F.lit(1)).alias("__n"))
    hit = edges.join(targets.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").groupBy("src_id").agg(F.count_distinct("dst_id").alias("n_shared"))
    return hit.join(F.broadcast(n), F.col("n_shared") == F.col("__n")).drop("__n")


def frontier(first: DataFrame, seeds: DataFrame, hub_ids: DataFrame, limit: int = 100) -> DataFrame:
    """(id) worth a second hop: companies, persons and audit firms that are neither seeds nor hubs; the first `limit` by id,
    the operator's purpose."""
    ends = first.select(F.explode(F.array(F.struct(F.col("src_id").alias("id"), F.col("src_type").alias("t")), F.struct(F.col("dst_id").alias("id"), F.col("dst_type").alias("t")))).alias("x")).select("x.*")
    ids = ends.where(F.col("t").isin(*_SEEDED)).select("id").distinct()
    return ids.join(seeds.select("id"), "id", "left_anti").join(hub_ids.select(F.col("entity_id").alias("id")), "id", "left_anti").orderBy("id").limit(limit)


def two_hops(edges: DataFrame, seeds: DataFrame, hub_ids: DataFrame, relations: tuple[list[str], list[str]] | None = None, years: list[str] = (), fanout: tuple[int, int] = (50, 15), limit: int = 100) -> DataFrame:
    """Edges of one and two hops with their least hop; relations are those of either hop.

    A second hop starts from the frontier and enters no hub. The edges are written once and read by both hops.
    """
    one, two = relations if relations else (None, None)
    edges = cut_lineage(edges)
    first = cut_lineage(cap_per_seed(filter_years(neighbours(edges, seeds, one), list(years)), fanout[0]))
    start = frontier(first, seeds, hub_ids, limit)
    second = cap_per_seed(filter_years(neighbours(edges, start, two, hub_ids.select(F.col("entity_id").alias("id"))), list(years)), fanout[1])
    cols = ["edge_id", "rel", "src_id", "dst_id", "fiscal_year"]
    both = first.select(*cols, F.lit(1).alias("hop")).unionByName(second.select(*cols, F.lit(2).alias("hop")))
    return both.groupBy(*cols).agg(F.min("hop").alias("hop"))


def neighbour_triples(edges: DataFrame, seeds: DataFrame, hops: int = 1, fiscal_year: str = "") -> DataFrame:
    """(triple): 'start|relation|end' strings of one or two hops in both directions; a year restricts directors and transactions."""
    dated = (F.col("fiscal_year") == fiscal_year) | ~F.col("rel").isin("DIRECTOR_OF", "PARTY_TO") if fiscal_year else F.lit(True)
    e = edges.where(dated).select("rel", F.explode(F.array(F.struct(F.col("src_id").alias("a"), F.col("dst_id").alias("b")), F.struct(F.col("dst_id").alias("a"), F.col("src_id").alias("b")))).alias("x")).select("rel", "x.*").distinct()
    triple = F.concat_ws("|", "a", "rel", "b").alias("triple")
    first = e.join(seeds.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    out = first.select(triple)
    if hops == 2:
        out = out.unionByName(e.join(first.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(triple))
    return out.distinct()


def stake_totals(edges: DataFrame) -> DataFrame:
    """(company_id, pledged_pct): sum over a company's outgoing HOLDS_STAKE edges."""
    return edges.where("rel = 'HOLDS_STAKE'").groupBy(F.col("src_id").alias("company_id")).agg(F.sum("pledged_pct").alias("pledged_pct"))


def sub_graph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Fact edges of the asked ids (edge_id), with the transaction's fields."""
    return edges.where("rel in ('DIRECTOR_OF', 'PARTY_TO', 'AUDITED_BY', 'SUBSIDIARY_OF')").join(ids.select("edge_id").distinct(), "edge_id", "left_semi")


def seeds_of(linked: DataFrame, companies: DataFrame) -> DataFrame:
    """(id): the linked entities (entity_id, kind); a sector stands for its companies (company_id, sector)."""
    members = linked.where("kind = 'sector'").join(companies.where("company_id is not null"), F.col("entity_id") == F.col("sector")).select(F.concat(F.lit("C:"), "company_id").alias("id"))
    return linked.where("kind is null or kind <> 'sector'").where("entity_id <> ''").select(F.col("entity_id").alias("id")).unionByName(members).distinct()


def entity_labels(entities: DataFrame) -> DataFrame:
    """(entity_id, name, kind): one name and kind an entity, of its latest row with a name."""
    named = entities.where("entity_id is not null and canonical_name is not null")
    return named.groupBy("entity_id").agg(F.max(F.struct("updated_at", "row_id", "canonical_name", "kind")).alias("x")).select("entity_id", F.col("x.canonical_name").alias("name"), "x.kind")


def distances(edges: DataFrame, sources: DataFrame, max_hops: int = 3) -> DataFrame:
    """(id, hops): breadth-first distance from the sources (id), both directions, up to max_hops.

    One level a round; each vertex is visited once, as the visited are taken out of the frontier. Stops when no
    vertex is new.
    """
    ends = F.array(F.struct(F.col("src_id").alias("a"), F.col("dst_id").alias("b")), F.struct(F.col("dst_id").alias("a"), F.col("src_id").alias("b")))
    both = cut_lineage(edges.select(F.explode(ends).alias("x")).select("x.*").distinct())
    seen = sources.select("id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, max_hops + 1):
        new = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut_lineage(new.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def incomplete_transactions(edges: DataFrame) -> DataFrame:
    return edges.where("rel = 'PARTY_TO'").groupBy(F.col("dst_id").alias("txn")).agg(F.count_distinct("edge_id").alias("n_parties")).where("n_parties < 2")


def counts_by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src_id").alias("n_sources"), F.count_distinct("dst_id").alias("n_targets"))

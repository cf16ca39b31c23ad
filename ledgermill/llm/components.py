"""Connected groups of records by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgermill.operators.skew import skew_join_unique
from ledgermill.session import cut_lineage

#: A vertex with more edges than MAX_DEGREE (or 1/HUB_PARTS of all edge ends, if that is more) is split, so there are
#: at most HUB_PARTS hubs to broadcast.
MAX_DEGREE, HUB_PARTS = 20_000, 50_000
#: BETA is the rate of the start times, ROUNDS how far a cluster grows in one level. In full, growth would take about
#: log(n) / BETA rounds; it is stopped after ROUNDS. So an edge is cut with a chance of about BETA only where clusters are
#: narrower than ROUNDS, as most components of matched records are, and these end in one level. In wider ones the level
#: contracts balls of radius ROUNDS around the earliest starts, and the rest is left to the next level. A level costs one
#: shuffle of the edges a round, so few rounds on ever fewer edges are cheaper than full growth on all.
BETA, ROUNDS = 0.02, 5


def _shift(vertex: Column, seed: int) -> Column:
    """A draw from Exp(BETA) that depends on the vertex and the level only, so that a repeated task draws the same."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(1 << 40)) + 1).cast("double") / float((1 << 40) + 1)
    return -F.log(u) / BETA


def _split_hubs(edges: DataFrame, n_edges: int) -> DataFrame:
    """Replace each hub by sub-vertices of bounded degree, each linked to the hub itself; connectivity is the same.

    Sub-vertices are named 's', number, ':', hub; connected_groups marks all other names with a 'v'. No hub: the edges
    as they are.
    """
    bound = max(MAX_DEGREE, 2 * n_edges // HUB_PARTS)
    if n_edges <= bound:
        return edges
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    hubs = ends.groupBy("v").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > bound)
    hubs = hubs.withColumn("fan", F.ceil(F.col("d") / F.lit(bound))).drop("d")
    out = edges
    for end, other in (("src", "dst"), ("dst", "src")):
        h = F.broadcast(hubs.withColumnRenamed("v", end).withColumnRenamed("fan", f"fan_{end}"))
        out = out.join(h, end, "left").withColumn(f"via_{end}", F.when(
            F.col(f"fan_{end}").isNotNull(),
            F.concat(F.lit("s"), F.pmod(F.xxhash64(other), F.col(f"fan_{end}")).cast("string"), F.lit(":"), F.col(end))))
    moved = out.select(F.coalesce("via_src", "src").alias("src"), F.coalesce("via_dst", "dst").alias("dst"))
    spokes = hubs.select(F.col("v").alias("src"), F.explode(F.sequence(F.lit(0), (F.col("fan") - 1).cast("int"))).alias("i")).select(
        "src", F.concat(F.lit("s"), F.col("i").cast("string"), F.lit(":"), "src").alias("dst"))
    return moved.unionByName(spokes)


def _decompose(edges: DataFrame, seed: int) -> DataFrame:
    """(v, c): the cluster centre c of every vertex of edges.

    Vertex u starts at time -shift(u); its cluster advances one edge a round, and a vertex joins the cluster that
    reaches it first, that is, the u of greatest shift(u) - distance. After ROUNDS rounds what is still unreached stays
    with the cluster it has; every centre a vertex ever held is connected to it, so contraction is right at any stage.
    """
    ends = F.explode(F.array(
        F.struct("src", "dst", F.lit(1).alias("cost")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("cost")),
        F.struct("src", F.col("src").alias("dst"), F.lit(0).alias("cost")), F.struct(F.col("dst").alias("src"), "dst", F.lit(0).alias("cost"))))
    # each vertex also has a free edge to itself, so that a round reads the labels once and plans stay linear in ROUNDS
    both = edges.select(ends.alias("e")).select("e.*").repartition("src").distinct().persist()
    label = both.groupBy("src").agg(F.first("src").alias("c")).select(F.col("src").alias("v"), F.struct(_shift(F.col("src"), seed).alias("t"), F.col("src").alias("c")).alias("best"))
    for _ in range(ROUNDS):
        label = both.join(label.withColumnRenamed("v", "src"), "src").select(
            F.col("dst").alias("v"), F.struct((F.col("best.t") - F.col("cost")).alias("t"), F.col("best.c").alias("c")).alias("best"))
        label = label.groupBy("v").agg(F.max("best").alias("best"))
    out = cut_lineage(label.select("v", F.col("best.c").alias("c")))
    both.unpersist()
    return out


def connected_groups(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """(id, root) for every vertex of edges (src, dst STRING): equal roots mean linked directly or indirectly.

    Each level grows clusters from exponentially shifted starts, contracts them to super-vertices and goes on with the
    edges between clusters; the assignments of all levels are then composed. Null ends, self pairs and repeats link
    nothing new. Any string may be an id. A root is a name for the group, no member's id. An empty table gives an empty one. Hubs are split, and the composition joins split heavy clusters, so
    one group may hold any share of the rows.
    """
    base = edges.where("src is not null and dst is not null")
    marked = [F.concat(F.lit("v"), f("src", "dst")).alias(c) for f, c in ((F.least, "src"), (F.greatest, "dst"))]
    current = base.where("src <> dst").select(*marked).distinct()
    current = cut_lineage(current)
    assigned: DataFrame | None = None
    for level in range(max_levels):
        n_edges = current.count()
        if n_edges == 0:
            break
        spread = _split_hubs(current, n_edges)
        clusters = _decompose(spread, level)
        if assigned is None:
            assigned = clusters.withColumnRenamed("v", "id").withColumnRenamed("c", "root")
        else:
            step = clusters.withColumnRenamed("v", "root").withColumnRenamed("c", "next")
            assigned = cut_lineage(skew_join_unique(assigned, step, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        # no vertex of spread has more than a bounded number of edges, so plain joins stay balanced
        ahead = spread.join(clusters.select(F.col("v").alias("src"), F.col("c").alias("a")).hint("merge"), "src").join(clusters.select(F.col("v").alias("dst"), F.col("c").alias("b")).hint("merge"), "dst")
        ahead = ahead.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        current = cut_lineage(ahead.distinct())
    else:
        raise RuntimeError(f"edges are left after {max_levels} levels")
    if assigned is None:
        return base.select(F.col("src").alias("id"), F.col("dst").alias("root")).limit(0)
    return assigned.where(F.col("id").startswith("v")).select(F.substring("id", 2, 1 << 30).alias("id"), "root")


def smallest_member(groups: DataFrame) -> DataFrame:
    """(id, group_id) of groups of two or more: group_id is the smallest id among those of equal root."""
    heads = groups.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return skew_join_unique(groups, heads, "root").select("id", "group_id")


def _key(mark: str, *parts: str) -> Column:
    return F.concat(F.lit(mark), *[F.concat(F.length(p).cast("string"), F.lit(":"), F.col(p)) for p in parts])


def mention_links(mentions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and edges (src, dst) of the mentions problem.

    Mentions with a company_id take no part. A shared official id or a shared (kind, norm_name, context_company_id)
    becomes a vertex of its own, linked to each mention that has it, so a shared value costs one edge a mention and no
    pairs. Mentions' names start with 'm', such vertices' names with 'i' or 'n' and the length of each part before it, so
    that no two names are alike whatever characters they hold. Values of zeros only, nulls and empty strings link nothing.
    """
    m = mentions.where(F.col("mention_id").isNotNull() & ~F.coalesce(F.map_contains_key("ids", F.lit("company_id")), F.lit(False)))
    m = m.select("mention_id", "kind", "norm_name", "context_company_id", "ids")
    ids = m.select("mention_id", F.explode("ids").alias("k", "v")).where("v is not null and v <> '' and not v rlike '^0+$'")
    m = m.withColumn("src", F.concat(F.lit("m"), "mention_id"))
    by_id = ids.select(F.concat(F.lit("m"), "mention_id").alias("src"), _key("i", "k", "v").alias("dst"))
    by_name = m.where("kind <> '' and norm_name <> '' and context_company_id <> ''").select(
        "src", _key("n", "kind", "norm_name", "context_company_id").alias("dst"))
    vertices = m.select(F.col("src").alias("id")).distinct()
    p = pairs.where("mention_a <> mention_b and method is not null and method <> 'review_queue'").select(
        F.concat(F.lit("m"), "mention_a").alias("src"), F.concat(F.lit("m"), "mention_b").alias("dst"))
    known = skew_join_unique(p, vertices.withColumnRenamed("id", "src"), "src")
    known = skew_join_unique(known, vertices.withColumnRenamed("id", "dst"), "dst").select("src", "dst")
    return vertices, by_id.unionByName(by_name).unionByName(known)


def mention_groups(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mention_id, group_id) of every mention in a group of two or more."""
    _, edges = mention_links(mentions, pairs)
    groups = connected_groups(edges).where(F.col("id").startswith("m")).select(F.substring("id", 2, 1 << 30).alias("id"), "root")
    return smallest_member(groups).select(F.col("id").alias("mention_id"), "group_id")

"""Linking of the names in questions to entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgermill.functions.fuzzy import set_ratio, sorted_ratio
from ledgermill.functions.text import norm_company, norm_person
from ledgermill.session import cut_lineage

#: Candidates scored for a mention, score from which one links, lead of a clear winner, near ties kept.
POOL, LINK_FROM, LEAD, KEPT = 25, 85, 5, 2


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity_id, kind, name): canonical names and aliases of all rows, distinct."""
    alias = F.filter(F.concat(F.array("canonical_name"), F.coalesce(F.split("aliases_text", r"\|"), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return entities.where("entity_id is not null").select("entity_id", "kind", F.explode(alias).alias("name")).distinct()


def entity_search(mentions: DataFrame, entities: DataFrame, limit: int = POOL) -> DataFrame:
    """(mention_no, entity_id, kind, name, search_score, rank): entities a mention (mention_no, text, kind or null) finds, best first.

    An entity is found if every word of the mention of two or more letters begins a word of its names and aliases taken
    together. Only the mention's rarest word meets the beginnings of the entities' words, by equi-join; the others are
    looked up in the words of the entities found. Of the found the greatest sorted-word similarity of a name ranks.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 1))
    names = entity_names(entities)
    asked = mentions.select("mention_no", "text", F.col("kind").alias("want"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    q = asked.select("mention_no", F.explode("ws").alias("w"))
    own = names.groupBy("entity_id", "kind").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("name"))))).alias("es"))
    begins = F.array_distinct(F.flatten(F.transform("es", lambda e: F.transform(F.sequence(F.lit(2), F.length(e)), lambda n: F.substring(e, F.lit(1), n)))))
    begun = cut_lineage(own.where(F.size("es") > 0).select("entity_id", "kind", "es", F.explode(begins).alias("w")).join(q.select("w").distinct(), "w", "left_semi"))
    rare = q.join(begun.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w", "left").groupBy("mention_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("x")).where("x.n > 0").select("mention_no", "x.w")
    every = F.forall("ws", lambda w: F.exists("es", lambda e: F.startswith(e, w)))
    found = rare.join(asked, "mention_no").join(begun, "w").where("want is null or want = kind").where(every).select("mention_no", "text", "entity_id", "kind")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sorted_ratio(x.lower(), y.lower()) for x, y in zip(a, b)])

    scored = found.join(names.select("entity_id", "name").distinct(), "entity_id").withColumn("s", alike("text", "name"))
    best = scored.groupBy("mention_no", "text", "entity_id", "kind").agg(F.max("s").alias("search_score"))
    w = Window.partitionBy("mention_no").orderBy(F.desc("search_score"), "entity_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def link_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_no, entity_id, score, status): each mention's entity if it leads clearly, up to KEPT near ties as ambiguous, or one row unlinked.

    A mention that finds nothing under its kind is searched without it. The score is the greatest word-set similarity
    of normalised names, rounded down; equal scores go by the search's.
    """
    first = cut_lineage(entity_search(mentions, entities))
    missed = mentions.where("kind is not null").join(first.select("mention_no").distinct(), "mention_no", "left_anti").withColumn("kind", F.lit(None).cast("string"))
    found = first.unionByName(entity_search(missed, entities)) if not missed.isEmpty() else first

    @F.pandas_udf("int")
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int(set_ratio(x, y)) for x, y in zip(a, b)])

    norm = lambda c: F.when(F.col("kind") == "person", norm_person(F.col(c))).otherwise(norm_company(F.col(c)))
    named = found.join(entity_names(entities).select("entity_id", "name").distinct(), "entity_id").withColumn("a", norm("text")).withColumn("b", norm("name"))
    s = named.withColumn("score", match("a", "b")).groupBy("mention_no", "entity_id", "search_score").agg(F.max("score").alias("score")).where(F.col("score") >= LINK_FROM)
    w = Window.partitionBy("mention_no").orderBy(F.desc("score"), F.desc("search_score"), "entity_id")
    r = s.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("clear", F.first(F.coalesce(F.col("score") - F.col("next") >= LEAD, F.lit(True))).over(w))
    kept = r.where((F.col("r") == 1) | (~F.col("clear") & (F.col("r") <= KEPT))).select("mention_no", "entity_id", F.col("score").cast("double").alias("score"), F.when(F.col("clear"), "linked").otherwise("ambiguous").alias("status"))
    out = mentions.select("mention_no").distinct().join(kept, "mention_no", "left")
    return out.select("mention_no", F.coalesce("entity_id", F.lit("")).alias("entity_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("status", F.lit("unlinked")).alias("status"))


def link_questions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, score, status): links of mentions (query_id, pos, text, kind), each distinct text and kind linked once; an entity once a question, the first."""
    kinds = F.when(F.col("kind").isin("company", "person", "audit_firm"), F.col("kind"))
    m = mentions.withColumn("kind", kinds).withColumn("mention_no", F.xxhash64("text", F.coalesce("kind", F.lit(""))))
    linked = link_mentions(m.select("mention_no", "text", "kind").distinct(), entities).where("status <> 'unlinked'")
    return m.select("query_id", "pos", "mention_no").join(linked, "mention_no").groupBy("query_id", "entity_id").agg(F.min_by(F.struct("score", "status"), F.struct("pos", -F.col("score"))).alias("x")).select("query_id", "entity_id", "x.*")

"""One surviving record for each group of duplicates, from consistent bundles of fields."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgermill.llm.ocr import fold
from ledgermill.operators.skew import skew_join_unique

#: Fixed values that stand for a missing name.
PLACEHOLDERS = ["", "-", "--", ".", "?", "N/A", "NA", "NIL", "NONE", "NULL", "UNKNOWN", "TBD", "SEE ABOVE", "NOT AVAILABLE", "AS ABOVE", "DITTO"]
#: Last words of a company's or firm's full name.
LEGAL_FORMS = r"(?i)(?:\b(?:limited|llp|corporation|company|incorporated|plc)|\b& (?:associates|co\.?|company|sons|partners)|\bassociates)$"
#: Short forms of words in names.
SHORT_FORMS = r"(?i)\b(?:pvt|ltd|limted|corp|corpn|inc|engg|mfg|svcs|hldgs|intl|secs|invts|inds|p)\b"
SOURCE_TRUST = {"registry": 3, "manual": 2, "filing": 1, "ocr": 0}
#: Trust of one place by recency of a name; more than an origin can have.
NAME_WEIGHT = 8


def tidy(col: Column) -> Column:
    """Trimmed, with single inner spaces."""
    return F.trim(F.regexp_replace(col, r"[\s\x{00A0}]+", " "))


def is_placeholder(col: Column) -> Column:
    return F.upper(tidy(col)).isin(*PLACEHOLDERS)


def alias_rows(rows: DataFrame) -> DataFrame:
    """(entity_id, alias): the distinct aliases of each entity, tidied; blanks and placeholders left out, case kept."""
    a = rows.where("aliases_text is not null").select("entity_id", F.explode(F.split("aliases_text", r"\|")).alias("alias"))
    return a.select("entity_id", tidy(F.col("alias")).alias("alias")).where(~is_placeholder(F.col("alias"))).distinct()


def intact_names(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (row_id, entity_id, kind, canonical_name, source, updated_at) whose canonical_name is intact.

    Not intact: null, blank, a placeholder, all capitals or all small letters, a short form or an initial, a company or
    firm without legal form, ending in an ellipsis, holding a character no name has; cut off, that is, the beginning of
    a longer name or alias of the same entity (a company's full legal name excepted); misread, that is, having a word
    that another word of equal fold outnumbers three to one over all names and aliases of all entities.
    """
    n = tidy(F.col("canonical_name"))
    plain = rows.where("canonical_name is not null").withColumn("__n", n).where(~is_placeholder(F.col("canonical_name")))
    is_person = F.col("kind") == "person"
    good = plain.where(
        (F.col("__n") != F.upper("__n")) & (F.col("__n") != F.lower("__n"))
        & ~F.col("__n").rlike(r"(?:…|\.\.+|-)$") & ~F.col("__n").rlike(r"[0-9!|@#$%*_=<>?\x{00C0}-\x{024F}]")
        & ~F.col("__n").rlike(SHORT_FORMS)
        & ~F.regexp_replace("__n", r"(?i)& co\.$", "").rlike(r"\.(?:\s|$)") & ~F.col("__n").rlike(r"(?:^|\s)\p{L}(?:\s|$)")
        & (F.when(is_person, F.col("__n").contains(" ")).otherwise(F.col("__n").rlike(LEGAL_FORMS))))

    seen = rows.where("canonical_name is not null").select("entity_id", n.alias("s")).where(~is_placeholder(F.col("s")))
    seen = seen.unionByName(aliases.select("entity_id", F.col("alias").alias("s"))).distinct()

    # in byte order all longer forms of a beginning follow it at once, so the next form tells whether there is one
    key = fold(F.regexp_replace("s", r"[^\p{L}\p{N}! ]", ""))
    whole = seen.select("entity_id", key.alias("f")).where("length(f) > 2").distinct()
    following = F.lead("f").over(Window.partitionBy("entity_id").orderBy("f"))
    heads = whole.withColumn("next", following).where(F.col("next").startswith(F.col("f"))).select("entity_id", "f")

    words = seen.select("entity_id", F.explode(F.split(F.lower("s"), r"[^\p{L}\p{N}!]+")).alias("w")).where(F.length("w") > 2)
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("f", fold(F.col("w")))
    top = counts.groupBy("f").agg(F.max("n").alias("top"))
    misread = counts.join(top, "f").where("top >= 3 * n").select("w")

    good = good.withColumn("f", fold(F.regexp_replace("__n", r"[^\p{L}\p{N}! ]", "")))
    cut = good.where(is_person).join(heads, ["entity_id", "f"], "left_semi").select("row_id")
    bad = good.select("row_id", F.explode(F.split(F.lower("__n"), r"[^\p{L}\p{N}!]+")).alias("w")).join(misread, "w", "left_semi").select("row_id")
    return good.join(cut.unionByName(bad).distinct(), "row_id", "left_anti").drop("__n", "f")


def best_combination(bundles: list[list[dict]]) -> list[dict] | None:
    """One candidate of every bundle, maximal in summed trust, such that shared determined attributes agree.

    bundles: for each bundle its candidates, dicts with trust (int), fixed (attribute -> value, the attributes the key
    determines) and anything else. Branch and bound: candidates by falling trust, a branch is left when even the best
    candidates of the remaining bundles cannot beat the best found. None if no consistent combination exists. A null
    value agrees with every value.
    """
    order = sorted(range(len(bundles)), key=lambda i: len(bundles[i]))
    ranked = [sorted(bundles[i], key=lambda c: -c["trust"]) for i in order]
    if any(not c for c in ranked):
        return None
    bound = [0] * (len(ranked) + 1)
    for i in range(len(ranked) - 1, -1, -1):
        bound[i] = bound[i + 1] + ranked[i][0]["trust"]
    best: list = [None, None]

    def branch(i: int, fixed: dict, trust: int, chosen: list) -> None:
        if best[0] is not None and trust + bound[i] <= best[0]:
            return
        if i == len(ranked):
            best[:] = [trust, list(chosen)]
            return
        for c in ranked[i]:
            if any(v is not None and fixed.get(k, v) != v for k, v in c["fixed"].items()):
                continue
            branch(i + 1, fixed | {k: v for k, v in c["fixed"].items() if v is not None}, trust + c["trust"], [*chosen, c])

    branch(0, {}, 0, [])
    if best[1] is None:
        return None
    out: list = [None] * len(bundles)
    for place, c in zip(order, best[1]):
        out[place] = c
    return out


_CANDIDATE = "struct<trust:bigint,kind:string,value:string,source:string,updated_at:string,row_id:bigint>"
_CHOSEN = "struct<kind:string,canonical_name:string,name_row_id:bigint,source:string,updated_at:string>"


def surviving_entities(rows: DataFrame) -> DataFrame:
    """One row per non-null entity_id: kind, canonical_name, name_row_id, source, updated_at, n_rows.

    Bundles: the identity (kind, canonical_name) of one intact row and the origin (kind, source, updated_at) of one row;
    entity_id determines kind, so both must agree on it. An identity's trust is NAME_WEIGHT times its place by recency
    among the entity's identities, an origin's is its source's trust plus one where the row has aliases. NAME_WEIGHT is
    more than any origin's trust, so the latest intact name with some origin of its kind always wins, as p3_found
    asks, and the origin gives way. Only the latest candidate of a (kind, source) can be in a best choice, so an
    entity's candidates are reduced to one each by a map-side aggregation before any search: a huge group stays spread, and
    the search sees at most as many as there are kinds times sources. Ties go to the greatest row_id. No intact name:
    canonical_name null. Repeated rows count once in n_rows. Aliases: see alias_rows.
    """
    base = rows.where("entity_id is not null").select("row_id", "entity_id", "kind", "canonical_name", "aliases_text", "source", "updated_at")
    micros = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0))
    source_trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TRUST.items() for x in kv]), F.col("source")), F.lit(0))

    def candidates(df: DataFrame, trust: Column, value: Column, by: list[str], name: str) -> DataFrame:
        c = F.struct(trust.cast("bigint").alias("trust"), "kind", value.alias("value"), "source", F.col("updated_at").cast("string").alias("updated_at"), F.col("row_id").cast("bigint").alias("row_id"))
        top = df.groupBy("entity_id", *by).agg(F.max_by(c, F.struct(trust, micros, "row_id")).alias("c"))
        return top.groupBy("entity_id").agg(F.collect_list("c").alias(name))

    identity = candidates(intact_names(base, alias_rows(base)), micros, F.col("canonical_name"), ["kind"], "identity")
    has_aliases = F.coalesce(~is_placeholder(F.col("aliases_text")), F.lit(False)).cast("int")
    origin = candidates(base, source_trust + has_aliases, F.col("source"), ["kind", "source"], "origin")
    count = base.groupBy("entity_id").agg(F.count_distinct("row_id").alias("n_rows"))

    @F.pandas_udf(_CHOSEN)
    def choose(identity: pd.Series, origin: pd.Series) -> pd.DataFrame:
        out = []
        for i, o in zip(identity, origin):
            names, origins = ([dict(c) | {"fixed": {"kind": c["kind"]}} for c in (x if x is not None else [])] for x in (i, o))
            for place, c in enumerate(sorted(names, key=lambda c: (c["trust"], c["row_id"])), 1):
                c["trust"] = NAME_WEIGHT * place
            name, src = best_combination([names, origins]) if names else (None, max(origins, key=lambda c: (c["trust"], c["row_id"])))
            out.append({
                "kind": (name or src)["kind"], "canonical_name": name["value"] if name else None, "name_row_id": name["row_id"] if name else None,
                "source": src["source"], "updated_at": src["updated_at"]})
        return pd.DataFrame(out, columns=["kind", "canonical_name", "name_row_id", "source", "updated_at"]).astype({"name_row_id": "Int64"})

    chosen = origin.join(identity, "entity_id", "left").select("entity_id", choose("identity", "origin").alias("s")).select("entity_id", "s.*")
    return chosen.join(count, "entity_id")


def with_aliases(survivors: DataFrame, rows: DataFrame) -> DataFrame:
    """Survivors with aliases, the sorted array of an entity's distinct aliases: one value a row, as asked of a survivor."""
    listed = alias_rows(rows.where("entity_id is not null")).groupBy("entity_id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return survivors.join(listed, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", empty))


def survivor_fields(rows: DataFrame) -> DataFrame:
    """(entity_id, field_name, best_value) of entities with two or more rows; aliases stay rows, none is collected."""
    names = surviving_entities(rows).where("n_rows > 1 and canonical_name is not null").select(
        "entity_id", F.lit("canonical_name").alias("field_name"), F.col("canonical_name").alias("best_value"))
    base = rows.where("entity_id is not null")
    many = base.groupBy("entity_id").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).where("a < b").select("entity_id")
    aliases = skew_join_unique(alias_rows(base), many, "entity_id")
    return names.unionByName(aliases.select("entity_id", F.lit("aliases_text").alias("field_name"), F.col("alias").alias("best_value")))

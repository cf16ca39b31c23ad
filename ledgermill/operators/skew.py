"""Aggregations and joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy when it holds more than 1/HEAVY_PARTS of the rows, so there are fewer than HEAVY_PARTS heavy keys:
#: that bounds every broadcast in this module whatever the size of the data.
HEAVY_PARTS = 1000


def heavy_keys(df: DataFrame, key: str, parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys with more than 1/parts of df's rows (at most parts - 1 of them), one column named as key. Nulls are no key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return (
        counts.where(F.col(key).isNotNull())
        .join(F.broadcast(total), F.col("__n") * parts > F.col("__total"))
        .select(key)
    )


def skew_join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 64, parts: int = HEAVY_PARTS) -> DataFrame:
    """Equi-join of left with right, whose key is unique, without a long task for left's heavy keys.

    Left rows of a heavy key get one of `salts` salts, and right's row of that key is repeated for each salt: fewer than
    parts * salts more rows. The salt is a hash of the left row, so a repeated task routes it alike. how is "inner" or
    "left". A null key joins nothing. Empty inputs give an empty or unmatched result. Left's columns must be hashable.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    heavy = F.broadcast(heavy_keys(left.select(key), key, parts).withColumn("__fan", F.lit(salts)))
    fan = F.coalesce("__fan", F.lit(1))
    cols = left.columns
    salted = left.join(heavy, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*cols), fan).cast("int")).drop("__fan")
    copies = right.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("__fan")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def salted_profile(
    df: DataFrame,
    key_fields: list[str],
    value_field: str,
    order_fields: list[str],
    salts: int = 64,
    parts: int = HEAVY_PARTS,
) -> DataFrame:
    """Rows, distinct counterparts and latest value of every key, by two-stage salted aggregation.

    Input: key_fields holds two columns, each the other's counterpart. Output, one row per (key_field, key_value) with
    a non-null key: n_rows (repeats included), n_counterparts (distinct non-null), latest_value (that of the greatest
    order_fields, then of the greatest value; nulls order first, so a key with only null values gives null).

    Equal (key, counterpart) pairs are first combined, map-side too, so no pair is heavy. A heavy key's pairs then get
    a salt and are combined per (key, salt), and the at most `salts` partial results per key are merged by the key.
    The salt is a hash of the counterpart rather than a random draw, so a repeated task gives the same rows, and each
    counterpart lies under one salt, so that the distinct counts of the salts add up. An empty table gives no row.
    """
    if len(key_fields) != 2:
        raise ValueError("key_fields must name two columns")
    a, b = key_fields
    latest = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_fields)], F.col(value_field).alias("v")))

    def side(key: str, other: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(
            F.lit(key).alias("key_field"),
            F.col(key).cast("string").alias("key_value"),
            F.col(other).cast("string").alias("counterpart"),
            *[F.col(c) for c in dict.fromkeys([*order_fields, value_field])],
        )

    pairs = (
        side(a, b).unionByName(side(b, a))
        .groupBy("key_field", "key_value", "counterpart")
        .agg(F.count(F.lit(1)).alias("n"), latest.alias("last"))
    )
    counts = pairs.groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    heavy = (
        counts.join(F.broadcast(total), F.col("c") * parts > F.col("t"))
        .select("key_field", "key_value", F.lit(salts).alias("fan"))
    )
    partial = (
        pairs.join(F.broadcast(heavy), ["key_field", "key_value"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("counterpart"), F.coalesce("fan", F.lit(1))))
        .groupBy("key_field", "key_value", "salt")
        .agg(F.sum("n").alias("n"), F.count("counterpart").alias("d"), F.max("last").alias("last"))
    )
    return partial.groupBy("key_field", "key_value").agg(
        F.sum("n").alias("n_rows"), F.sum("d").alias("n_counterparts"), F.max("last")["v"].alias("latest_value")
    )


def over_share(profile: DataFrame, total_rows: DataFrame, share: float) -> DataFrame:
    """Keys of a salted_profile that hold more than `share` of all rows; total_rows is a one-row table with column n."""
    return profile.join(F.broadcast(total_rows), F.col("n_rows") > F.col("n") * F.lit(share)).select("key_field", "key_value")


#: Members of a group that meet all others in one task.
PART = 1000


def pairs_in_groups(df: DataFrame, key: str, columns: list[str], part: int | None = None) -> DataFrame:
    """(c_a, c_b for each of columns): every pair of different rows of one key once, the smaller row first.

    A group of more than `part` rows is made in parts of it, so no task makes a large group's square. Rows must be
    distinct; a null key joins nothing.
    """
    rows = df.select(key, F.struct(*columns).alias("__x")).where(F.col(key).isNotNull())
    fans = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / (part or PART)).cast("int").alias("__parts"))
    sized = skew_join_unique(rows, fans, key)
    a = sized.select(key, F.pmod(F.xxhash64("__x"), F.col("__parts")).cast("int").alias("__p"), F.col("__x").alias("__a"))
    b = sized.select(key, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__p"), F.col("__x").alias("__b"))
    j = a.join(b.hint("merge"), [key, "__p"]).where(F.col("__a") < F.col("__b"))
    return j.select(*[F.col(f"__{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in columns])

"""Keyed sinks as declarative rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with new's rows replacing equal keys; of new rows with equal keys the one greatest by all columns stays."""
    w = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *[F.col(c).cast("string").desc_nulls_last() for c in new.columns])
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


def inserted_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys))


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges partitioned by relation, so that a traversal reads the relations it asks for."""
    edges.write.mode("overwrite").partitionBy("rel").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def with_status(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the status of changes (key, status) where the key has one; one change a key."""
    c = changes.groupBy(key).agg(F.max("status").alias("__status"))
    return existing.join(c, key, "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def merged_edges(existing: DataFrame, new: DataFrame, collapse_pairs: bool = False) -> DataFrame:
    """Edges upserted by edge_id, or, with collapse_pairs, by (rel, src_id, dst_id), so that a pair keeps one edge."""
    return upserted(existing, new, ["rel", "src_id", "dst_id"] if collapse_pairs else ["edge_id"])


def write_run(path: str, config: dict, results: DataFrame | None = None, scores: DataFrame | None = None) -> None:
    """Artefacts of a run under path: config.json, written once; results, appended; scores, replaced."""
    import json
    from pathlib import Path

    where = Path(path)
    where.mkdir(parents=True, exist_ok=True)
    if not (where / "config.json").exists():
        (where / "config.json").write_text(json.dumps(config, indent=2))
    if results is not None:
        results.write.mode("append").json(f"{path}/results")
    if scores is not None:
        scores.write.mode("overwrite").json(f"{path}/scores")


def write_index(chunks: DataFrame, embed, path: str) -> None:
    """Vectors of the chunks that have text: chunk_id and embedding, by an injected embedding of a text column."""
    chunks.where(F.trim("text") != "").select("chunk_id", embed(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(path)

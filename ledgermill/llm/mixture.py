"""Mixing of sources to target shares of tokens by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgermill.llm.tokenizers import count_tokens
from ledgermill.session import cut_lineage

FAN_IN = 64
#: Documents are settled in classes: those of more than a tenth of the tokens their source is to give, then those of more
#: than a hundredth, then the rest.
CLASSES = (0.1, 0.01, 0.0)
_OUT = "doc_id bigint, source string, n_tokens bigint, base int, p double, copies int"


def source_key(col: str):
    """One spelling of a source name: trimmed, small letters, runs of spaces and hyphens as an underscore."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s\-_]+", "_")


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: documents, tokens, reachable share, the tokens aimed at and the mean copies of a document.

    The mixture is the largest in which every source with tokens has its share; sources without tokens get none, and
    the other shares are scaled to sum to 1. The source that is exhausted first uses each document max_repeats times.
    """
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    t = targets.groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = F.broadcast(t).join(have, "source", "left").na.fill({"n_docs": 0, "n_tokens": 0})
    t = t.withColumn("usable", (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    size = t.where("usable").agg(
        F.sum("target_share").alias("__sum"),
        F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")).alias("__per_share"))
    full = t.crossJoin(F.broadcast(size)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens",
        F.when(F.col("usable"), F.col("target_share") / F.col("__sum")).otherwise(0.0).alias("reachable_share"),
        F.when(F.col("usable"), F.col("target_share") * F.col("__per_share")).otherwise(0.0).alias("aim_tokens"))
    return full.withColumn("mean_copies", _mean("aim_tokens", "n_tokens"))


def _mean(aim: str, tokens: str):
    return F.greatest(F.lit(0.0), F.least(F.col("max_repeats").cast("double"), F.coalesce(F.try_divide(F.col(aim), F.col(tokens)), F.lit(0.0))))


def _draw(*parts) -> float:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big") / 2.0**64


def pivot(a: dict, b: dict, seed: int) -> tuple[dict, dict]:
    """Move probability between a and b, keeping p_a * w_a + p_b * w_b and both expectations, until one is 0 or 1.

    Returns (settled, open). The draw depends on the two ids and the seed only.
    """
    wa, wb = a["n_tokens"], b["n_tokens"]
    up = min((1 - a["p"]) * wa, b["p"] * wb)  # tokens that a may gain
    down = min(a["p"] * wa, (1 - b["p"]) * wb)  # tokens that a may lose
    d = up if _draw(seed, a["doc_id"], b["doc_id"]) * (up + down) < down else -down
    for x, gain, w in ((a, d, wa), (b, -d, wb)):
        x["p"] = min(1.0, max(0.0, x["p"] + gain / w))
        if x["p"] < 1e-9 or x["p"] > 1 - 1e-9:
            x["p"] = float(round(x["p"]))
    return (a, b) if a["p"] in (0.0, 1.0) else (b, a)


def _settle(x: dict) -> dict:
    return x | {"copies": int(x["base"] + x["p"])}


def _round_batches(seed: int, last: bool, nearest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, dict] = {}
        cols = ["doc_id", "source", "n_tokens", "base", "p", "copies"]
        for pdf in batches:
            out = []
            for x in pdf.to_dict("records"):
                if x["p"] <= 0.0 or x["p"] >= 1.0:
                    out.append(_settle(x))
                    continue
                other = open_.pop(x["source"], None)
                if other is not None:
                    done, x = pivot(other, x, seed)
                    out.append(_settle(done))
                if x["p"] in (0.0, 1.0):
                    out.append(_settle(x))
                else:
                    open_[x["source"]] = x
            if out:
                yield pd.DataFrame(out, columns=cols)
        rest = []
        for x in open_.values():
            if last:
                x["p"] = float(x["p"] > 0.5 if nearest else _draw(seed, x["doc_id"]) < x["p"])
                rest.append(_settle(x))
            else:
                rest.append(x | {"copies": None})
        if rest:
            yield pd.DataFrame(rest, columns=cols).astype({"copies": "Int32"})

    return run


def size_documents(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the target sources that have tokens; each doc_id once."""
    wanted = F.broadcast(targets.select(source_key("source").alias("source")).distinct())
    d = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", source_key("source").alias("source"), "text")
    d = d.join(wanted, "source", "left_semi").select("doc_id", "source", count_tokens(F.col("text"), path).alias("n_tokens"))
    return d.where("n_tokens > 0").groupBy("doc_id").agg(F.min_by("source", F.struct("source", "n_tokens")).alias("source"), F.min("n_tokens").alias("n_tokens"))


def _pivotal(sized: DataFrame, plan: DataFrame, seed: int, nearest: bool) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of sized by the plan's mean_copies; see mix."""
    shares = plan.select("source", F.floor("mean_copies").cast("int").alias("base"), (F.col("mean_copies") - F.floor("mean_copies")).alias("p"))
    items = sized.join(F.broadcast(shares), "source").select("doc_id", "source", "n_tokens", "base", "p")
    items = items.withColumn("copies", F.lit(None).cast("int"))
    width, out = max(1, items.rdd.getNumPartitions()), None
    while True:
        done = cut_lineage(items.mapInPandas(_round_batches(seed, width == 1, nearest), _OUT))
        settled = done.where("copies is not null")
        out = settled if out is None else out.unionByName(settled)
        if width == 1:
            return out.select("doc_id", "source", "n_tokens", "copies")
        width = (width + FAN_IN - 1) // FAN_IN
        # at most one open row a source and partition: few rows, in a fixed order so that a repeated task pairs alike
        items = done.where("copies is null").repartition(width, "source", "doc_id").sortWithinPartitions("source", "doc_id")


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): copies has (doc_id, source, n_tokens, copies) of every document of a target source.

    A document's expected copies are its source's mean_copies; the whole part is given to all, the fraction by weighted
    pivotal rounding: within a partition open fractions are settled in pairs, leaving one open document a source, and
    the open ones go up a tree of FAN_IN partitions a node until one is left. Large documents are settled first (see
    CLASSES), the last open one to the nearest; each later class shares what the earlier leave of the aim, so a source
    misses its aim by a hundredth or less, as long as its smaller documents can make up for the larger ones.
    Documents with null source or without tokens take no part; an empty table gives an empty mixture. A source of any
    share of the rows stays spread over all partitions.
    """
    sized = cut_lineage(size_documents(docs, targets, path))
    plan = cut_lineage(source_plan(sized, targets))
    share = F.col("n_tokens") / F.col("aim_tokens")
    size = sum([(share <= c).cast("int") for c in CLASSES[:-1]], F.lit(0))
    marked = sized.join(F.broadcast(plan.select("source", "aim_tokens")), "source").withColumn("__class", size).drop("aim_tokens")
    held = marked.groupBy("source", "__class").agg(F.sum("n_tokens").alias("t"))
    out = None
    for k in range(len(CLASSES)):
        left = held.where(F.col("__class") >= k).groupBy("source").agg(F.sum("t").alias("__have"))
        now = plan.join(F.broadcast(left), "source")
        if out is not None:
            spent = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("spent"))
            now = now.join(F.broadcast(spent), "source", "left").na.fill({"spent": 0}).withColumn("aim_tokens", F.col("aim_tokens") - F.col("spent"))
        now = now.withColumn("mean_copies", _mean("aim_tokens", "__have"))
        done = _pivotal(marked.where(F.col("__class") == k).drop("__class"), now, seed, k + 1 < len(CLASSES))
        out = done if out is None else out.unionByName(done)
    return out, plan


def reached_shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the tokens and the share of the mixture that each source really has."""
    got = copies.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_copies"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("__all"))
    return plan.join(F.broadcast(got), "source", "left").na.fill({"mixed_tokens": 0, "mixed_copies": 0, "most_copies": 0}).crossJoin(F.broadcast(total)).select(
        "source", "target_share", "reachable_share", "max_repeats", "n_docs", F.col("n_tokens").alias("available_tokens"),
        "mixed_tokens", "mixed_copies", "most_copies",
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("__all")), F.lit(0.0)).alias("actual_share"))

"""Cutting of long texts at natural boundaries into pieces under a token limit, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Boundaries from the most natural on: after a blank line, after a line end, after a sentence, after a word.
LEVELS = [
    regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*"),
    regex.compile(r"\r\n|\r|\n"),
    regex.compile(r"[.!?।]['\")\]]*\s+"),
    regex.compile(r"\s+"),
]
CHARS_PER_TOKEN = 4


def estimate(n_chars: int) -> int:
    return max(1, n_chars // CHARS_PER_TOKEN)


def cut_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets where text may be cut, and the level (0 the most natural) of each."""
    level = {}
    for k in range(len(LEVELS) - 1, -1, -1):
        for m in LEVELS[k].finditer(text):
            level[m.end()] = k
    level.pop(len(text), None)
    at = np.array(sorted(level), dtype=np.int64)
    return at, np.array([level[i] for i in at.tolist()], dtype=np.int8)


def spans(text: str, max_tokens: int = 800, overlap: int = 60, fill: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text, in order; together they cover it.

    The prefix sum of tokens up to offset i is i / CHARS_PER_TOKEN, so the limit is an offset: the last cut point under
    it is found by binary search in the sorted array of each level. The most natural level with a point in the last
    (1 - fill) of the piece wins; no point at all gives a hard cut at the limit. The next piece steps back by at most
    `overlap` tokens, to the first cut point there, or by a hard step if there is none.
    """
    n, limit, back = len(text), (max_tokens + 1) * CHARS_PER_TOKEN - 1, overlap * CHARS_PER_TOKEN
    if n <= limit:
        return [(0, n)]
    at, level = cut_points(text)
    by_level = [at[level <= k] for k in range(len(LEVELS))]
    out, start = [], 0
    while n - start > limit:
        most, least, end = start + limit, start + int(limit * fill), 0
        for points in by_level:
            k = int(np.searchsorted(points, most, side="right")) - 1
            if k >= 0 and points[k] > least:
                end = int(points[k])
                break
        else:
            k = int(np.searchsorted(at, most, side="right")) - 1
            end = int(at[k]) if k >= 0 and at[k] > start + back else most
        out.append((start, end))
        k = int(np.searchsorted(at, end - back, side="left"))
        step = int(at[k]) if k < len(at) and at[k] < end else end - back
        start = max(step, start + 1)
    out.append((start, n))
    return out


def split_table(df: DataFrame, text_col: str = "text", max_tokens: int = 800, overlap: int = 60) -> DataFrame:
    """df's columns without the text, with piece_no (from 0), n_pieces, piece_start, piece_end, piece, piece_tokens.

    Text within the limit is one piece; null and empty text gives one piece of empty text with 0 tokens. Only longer
    texts go through Python. Repeated rows give repeated pieces. A column of df with one of the new names is replaced.
    """
    limit = (max_tokens + 1) * CHARS_PER_TOKEN - 1
    new = ["piece_no", "n_pieces", "piece_start", "piece_end", "piece", "piece_tokens"]
    keep = [c for c in df.columns if c not in (text_col, *new)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.select(*keep, text.alias("__text"))
    short = src.where(F.length("__text") <= limit).select(
        *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.length("__text").alias("piece_end"),
        F.col("__text").alias("piece"),
        F.when(F.col("__text") == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length("__text") / CHARS_PER_TOKEN).cast("int"))).alias("piece_tokens"))

    @F.pandas_udf("array<struct<piece_no:int,n_pieces:int,piece_start:int,piece_end:int,piece:string,piece_tokens:int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = []
            for t in s:
                parts = spans(t, max_tokens, overlap)
                rows.append([
                    {"piece_no": i, "n_pieces": len(parts), "piece_start": a, "piece_end": b, "piece": t[a:b], "piece_tokens": estimate(b - a)}
                    for i, (a, b) in enumerate(parts)
                ])
            yield pd.Series(rows, dtype=object)

    long = src.where(F.length("__text") > limit).withColumn("__p", F.explode(cut("__text"))).select(*keep, "__p.*")
    return short.unionByName(long)

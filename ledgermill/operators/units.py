"""Conversion of amounts in mixed scales and currencies to rupees."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgermill.functions.amounts import read_amount, read_unit
from ledgermill.session import cut_lineage

#: Conversion factors a missing unit may have; their logarithms are the offsets of the mixture's components.
FACTORS = [1.0, 1e3, 1e5, 1e6, 1e7, 1e9]
#: Width of the histogram of log10 amounts; with amounts of 1e-6 to 1e24 that is 600 bins at most, whatever the data.
BIN = 0.05
CERTAIN = 0.9
RPT_SCHEMA = "amount_inr double, amount_raw string, fiscal_year string, evidence struct<quote:string>"
_READ = "struct<value:double,factor:double,currency:string,basis:string>"


_UNIT_WORD = r"(?:whole|of|in|INR|Rs|rupees?|₹|USD|US\$|S\$|SGD|EUR|€|GBP|£|JPY|¥|\$|crores?|crs?|lakhs?|lacs?|millions?|mn|mio|mln|billions?|bn|bln|trillion|tn|thousands?|['’]000s?|000['’]?s)"
_FRONT = re.compile(rf"^\s*(?:\(([^()]*)\)|((?:all\s+)?(?:amounts?|figures?)\s+(?:are\s+)?(?:stated\s+|expressed\s+)?in\s+(?:{_UNIT_WORD}(?![A-Za-z])[\s.]*)+))", re.I)


def note_unit(quote: str | None) -> tuple[float | None, str | None]:
    """(factor, currency) of the unit note of a quote 'party | kind | amount': beside the amount, or before the party's name.

    A note before the name is in brackets or begins with 'Amount in' or the like, so that words of the name are no unit.
    """
    if not isinstance(quote, str):
        return None, None
    unit = read_unit(quote.rsplit("|", 1)[-1])
    if unit[0] is not None:
        return unit
    m = _FRONT.match(quote.split("|", 1)[0])
    return read_unit(m.group(1) or m.group(2)) if m else (None, None)


def _stated(raw: pd.Series, quote: pd.Series) -> pd.DataFrame:
    out = []
    for r, q in zip(raw, quote):
        a, basis = read_amount(r), "raw"
        if a.value is not None and a.factor is None:
            f, c = note_unit(q)
            a, basis = a._replace(factor=f, currency=a.currency or c), "quote"
        out.append({"value": a.value, "factor": a.factor, "currency": a.currency, "basis": basis if a.factor is not None else None})
    return pd.DataFrame(out, columns=["value", "factor", "currency", "basis"])


def fit_scales(known: DataFrame, unknown: DataFrame) -> list[dict]:
    """Weights of FACTORS among amounts without a unit, with mean and deviation of log10 rupees: [{factor, weight, mu, sigma}].

    known has rupees and factor, unknown has value. A mixture of normals in log10, whose components all have the mean and
    deviation of the known amounts, moved by -log10(factor), is fitted by expectation maximisation on histograms of all
    amounts. The shares of the stated factors count as much as the data, so that wide deviations do not drive all weight
    to one factor. Nothing known: mean 7, deviation 2 and equal shares.
    """
    def hist(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
        # a histogram of at most (24 + 6) / BIN bins
        h = df.where(F.col(col) > 0).select(F.least(F.greatest(F.log10(F.col(col)), F.lit(-6.0)), F.lit(24.0)).alias("x"))
        rows = h.groupBy(F.floor(F.col("x") / BIN).alias("b")).count().collect()
        return np.array([(r["b"] + 0.5) * BIN for r in rows]), np.array([float(r["count"]) for r in rows])

    x, n = hist(known, "rupees")
    mu = float((x * n).sum() / n.sum()) if len(x) else 7.0
    sigma = max(0.1, math.sqrt(float((n * (x - mu) ** 2).sum() / n.sum()))) if len(x) else 2.0
    stated = {r["factor"]: r["count"] for r in known.where(F.col("factor").isin(*FACTORS)).groupBy("factor").count().collect()}
    prior = np.array([stated.get(f, 0) + 1.0 for f in FACTORS])
    prior /= prior.sum()
    offsets, w = np.log10(FACTORS), prior
    x, n = hist(unknown, "value")
    for _ in range(200):
        if not len(x):
            break
        like = w * np.exp(-0.5 * ((x[:, None] + offsets - mu) / sigma) ** 2) + 1e-300
        post = like / like.sum(axis=1, keepdims=True)
        new = ((n[:, None] * post).sum(axis=0) / n.sum() + prior) / 2
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return [{"factor": f, "weight": float(p), "mu": mu, "sigma": sigma} for f, p in zip(FACTORS, w)]


def posteriors(value: Column, fit: list[dict]) -> Column:
    """Array of (posterior, factor) of a value without unit, from a fit of fit_scales."""
    def like(c: dict) -> Column:
        z = (F.log10(F.abs(value)) + math.log10(c["factor"]) - c["mu"]) / c["sigma"]
        return F.lit(c["weight"]) * F.exp(-0.5 * z * z) + F.lit(1e-300)

    total = sum([like(c) for c in fit[1:]], like(fit[0]))
    return F.array(*[F.struct((like(c) / total).alias("posterior"), F.lit(c["factor"]).alias("factor")) for c in fit])


def transaction_amounts(records: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per rpt record: record_id, amount_inr, amount_raw, value, factor, currency, basis, posterior, uncertain, rupees.

    basis says where the unit comes from: raw, quote (a note beside the amount or before the party in the evidence), or mixture (no unit is
    stated; the most probable factor, its posterior, and uncertain where that is below CERTAIN). Foreign currency counts
    by rates of the payload's fiscal year; a missing rate or number gives null rupees and null basis. Null or malformed
    payloads give null fields. Repeated rows stay repeated; an empty table gives an empty result.
    """
    p = F.from_json("payload_json", RPT_SCHEMA)
    rpt = records.where("record_type = 'rpt'").select("record_id", p.alias("p")).select("record_id", "p.*").withColumn("quote", F.col("evidence.quote")).drop("evidence")
    read = F.pandas_udf(_stated, _READ)
    parsed = rpt.withColumn("a", read("amount_raw", "quote")).select("record_id", "amount_inr", "amount_raw", "fiscal_year", "a.*")
    return _to_rupees(cut_lineage(parsed), rates).drop("fiscal_year")  # read once, used by the fit and the result


def _to_rupees(parsed: DataFrame, rates: DataFrame, may_miss: str = "true") -> DataFrame:
    """parsed in rupees; rows without a unit where one may_miss (an expression) get it from the mixture."""
    year = F.concat(F.lit("FY"), F.regexp_extract("fiscal_year", r"(\d{4}-\d{2})", 1))
    # rates is a table of currencies and years that does not grow with the data
    r = F.broadcast(rates.groupBy("currency", "fiscal_year").agg(F.max("inr_per_unit").alias("rate")).withColumnRenamed("fiscal_year", "__fy"))
    df = parsed.withColumn("currency", F.when(F.col("factor").isNotNull(), F.coalesce("currency", F.lit("INR"))).otherwise(F.col("currency"))).withColumn("__fy", year)
    df = df.join(r, ["currency", "__fy"], "left").drop("__fy")
    df = df.withColumn("rate", F.when(F.coalesce("currency", F.lit("INR")) == "INR", F.lit(1.0)).otherwise(F.col("rate")))
    known = df.where("factor is not null").select("factor", F.abs(F.col("value") * F.col("factor") * F.col("rate")).alias("rupees"))
    unknown = df.where(f"factor is null and value is not null and {may_miss}").select(F.abs("value").alias("value"))
    best = F.array_max(posteriors(F.col("value"), fit_scales(known, unknown)))
    guess = F.col("factor").isNull() & F.col("value").isNotNull() & (F.col("value") != 0) & F.expr(may_miss)
    df = df.withColumn("__best", F.when(guess, best))
    return df.select(
        *[c for c in parsed.columns if c not in ("factor", "basis")],
        F.coalesce("factor", "__best.factor").alias("factor"),
        F.when(F.col("factor").isNotNull(), F.col("basis")).when(guess, F.lit("mixture")).alias("basis"),
        F.when(F.col("factor").isNotNull(), F.lit(1.0)).otherwise(F.col("__best.posterior")).alias("posterior"),
        F.coalesce(guess & (F.col("__best.posterior") < CERTAIN), F.lit(False)).alias("uncertain"),
        (F.col("value") * F.coalesce("factor", "__best.factor") * F.col("rate")).alias("rupees"))


def misstated_transactions(amounts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows of transaction_amounts with a stated unit whose amount_inr is off by more than the tolerance."""
    return amounts.where(F.col("basis").isin("raw", "quote") & F.col("amount_inr").isNotNull() & (F.abs(F.col("amount_inr") - F.col("rupees")) > tolerance * F.abs("rupees")))


_MONEY = "struct<value:double,factor:double,currency:string,basis:string,missing:boolean>"
#: Questions after a count or a share, whose answers are no money.
_NO_MONEY = re.compile(r"\bhow many\b|\bpercent(?:age)?s?\b|%|\bnumber of\b|\bratio\b", re.I)


def _answer(gold: pd.Series, unit: pd.Series, question: pd.Series, kind: pd.Series) -> pd.DataFrame:
    out = []
    for g, u, q, k in zip(gold, unit, question, kind):
        row = {"value": None, "factor": None, "currency": None, "basis": None, "missing": False}
        if isinstance(g, str) and k in (None, "number"):
            a = read_amount(g)
            row["value"] = a.value
            has_unit = isinstance(u, str) and u.strip() != ""
            f, c = read_unit(u if has_unit else None)
            if has_unit:
                if f is not None:
                    row |= {"factor": f, "currency": c or a.currency, "basis": "gold_unit"}
            elif a.factor is not None:
                row |= {"factor": a.factor, "currency": a.currency, "basis": "gold_answer"}
            elif isinstance(q, str):
                m = re.search(r"\bin ((?:INR|Rs\.?|₹|USD|US\$|EUR|€|GBP|£|JPY|¥|SGD|S\$|thousands?|lakhs?|lacs?|crores?|millions?|billions?|rupees|'000)[^?,;]{0,30})\??\s*$", q, re.I)
                f, c = read_unit(m.group(1)) if m else (None, None)
                if f is not None:
                    row |= {"factor": f, "currency": a.currency or c, "basis": "question"}
            if not has_unit and row["factor"] is None and not (isinstance(q, str) and _NO_MONEY.search(q)):
                row |= {"currency": a.currency, "missing": True}
        out.append(row)
    return pd.DataFrame(out, columns=["value", "factor", "currency", "basis", "missing"])


def answer_amounts(questions: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per question with a number: qid, value, factor, currency, basis, posterior, uncertain, rupees, crore.

    The unit is that of gold_unit, else of gold_answer, else of the question. Where none is stated it is the mixture's
    most probable factor, as in transaction_amounts, with its posterior and uncertain. A gold_unit that is no money
    (shares, %), and a question after a count or a share without unit, give null basis and null amounts. Foreign currency counts by the fiscal year in the question.
    """
    read = F.pandas_udf(_answer, _MONEY)
    q = questions.select("qid", "gold_answer", "gold_unit", "question", "answer_type").withColumn("a", read("gold_answer", "gold_unit", "question", "answer_type"))
    q = q.select("qid", F.regexp_extract("question", r"(\d{4}-\d{2})", 1).alias("fiscal_year"), "a.*").where("value is not null")
    t = _to_rupees(cut_lineage(q), rates, "missing")
    return t.select("qid", "value", "factor", "currency", "basis", "posterior", "uncertain", "rupees", (F.col("rupees") / 1e7).alias("crore"))


def answers_not_in_crore(amounts: DataFrame) -> DataFrame:
    """Rows of answer_amounts whose stated unit is another than crore of rupees."""
    return amounts.where("basis is not null and basis <> 'mixture' and not (factor = 1e7 and currency = 'INR')")

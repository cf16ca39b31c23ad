"""Scoring of answers, failure labels, aggregates and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.answers import score_answer
from ledgermill.functions.text import question_key
from ledgermill.operators.evidence import precision_of, recall_of

MIN_PAIRS = 5


#: Labels of failures; the first four and the last are for review by hand, the others are found here.
FAILURE_LABELS = ["entity_link_error", "missed_hop", "temporal_error", "data_error", "retrieval_miss", "arithmetic_error", "hallucination", "wrong_abstention", "bad_query", "budget_loop"]


def failure_label(status: Column, correct: Column, answerable: Column, faithful: Column, recall: Column, kind: Column) -> Column:
    """First label that applies to a scored answer; null for a success.

    status is ok, abstained, error or budget. An unanswerable question is a success when abstained from. A right answer
    its evidence does not support is a hallucination. A wrong one is a retrieval miss where none of the gold pages is
    cited or there are none, an arithmetic error where it is a number, else a hallucination.
    """
    success = F.lit(None).cast("string")
    wrong = F.when(recall == 0, "retrieval_miss").when(kind == "number", "arithmetic_error").when(recall.isNull(), "retrieval_miss").otherwise("hallucination")
    answered = F.when(status == "abstained", "wrong_abstention").when(faithful < 1, "hallucination").when(correct >= 1, success).otherwise(wrong)
    return (F.when(status == "error", "bad_query").when((status == "budget") & (correct < 1), "budget_loop")
            .when(~answerable, F.when(status == "abstained", success).otherwise("hallucination")).otherwise(answered))


def score_results(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores of results (run_id, qid, status, answer_short, cited, faithfulness, ...) against questions; one row a run and question.

    Abstaining is right for unanswerable questions only; errors and other abstentions are wrong; else the answer is
    scored by its kind. Pages are compared as (doc_id, page): recall is null without gold pages, accuracy without citations.
    """
    q = questions.select("qid", "category", "answer_type", "gold_answer", "gold_evidence")
    key = lambda x: F.concat_ws(":", x["doc_id"], x["page"].cast("string"))
    j = results.join(q, "qid").withColumn("answerable", ~F.col("category").eqNullSafe("unanswerable"))
    gold, cited = F.transform("gold_evidence", key), F.transform("cited", key)
    off = F.col("status").isin("error", "abstained")
    kind = F.when(F.col("answerable") & ~off, F.col("answer_type"))  # answers that are not compared need no scoring
    correct = F.when(~F.col("answerable"), (F.col("status") == "abstained").cast("double")).when(off, 0.0).otherwise(F.coalesce(score_answer(kind, F.col("answer_short"), F.col("gold_answer")), F.lit(0.0)))
    s = j.withColumn("correct", correct).withColumn("evidence_recall", recall_of(gold, cited)).withColumn("citation_accuracy", precision_of(gold, cited))
    return s.select(
        "run_id", "qid", "category", "answer_type", "correct", (F.col("status") == "abstained").alias("abstained"), (F.col("status") == "error").alias("error"), (F.col("status") == "budget").alias("budget_exceeded"), "faithfulness",
        "citation_accuracy", "evidence_recall", failure_label(F.col("status"), F.col("correct"), F.col("answerable"), F.col("faithfulness"), F.col("evidence_recall"), F.col("answer_type")).alias("failure_label"),
        "latency_ms", "cost_usd", "llm_calls", "tool_calls")


def summarize(scores: DataFrame) -> DataFrame:
    """Metrics of each run overall (category null) and by category, by grouping sets; null metrics are left out of means."""
    g = scores.groupingSets([["run_id", "category"], ["run_id"]], "run_id", "category")
    flag = lambda c: F.avg(F.col(c).cast("double"))
    failures = [F.count_if(F.col("failure_label") == x).alias(x) for x in FAILURE_LABELS[4:]]
    return g.agg(
        F.grouping("category").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), F.avg("correct").alias("correct_mean"), F.avg("faithfulness").alias("faithfulness_mean"), F.avg("citation_accuracy").alias("citation_accuracy_mean"),
        F.avg("evidence_recall").alias("evidence_recall_mean"), flag("abstained").alias("abstention_rate"), F.count_if("error").alias("error_count"), F.percentile("latency_ms", F.lit(0.5)).alias("latency_median_ms"),
        F.percentile("latency_ms", F.lit(0.9)).alias("latency_p90_ms"), F.avg("cost_usd").alias("cost_usd_mean"), F.avg("llm_calls").alias("llm_calls_mean"), F.avg("tool_calls").alias("tool_calls_mean"), flag("budget_exceeded").alias("budget_exceeded_rate"), *failures)


def bootstrap_interval(values: np.ndarray, n: int = 2000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the mean over n resamples of numpy's default generator."""
    if not len(values):
        return float("nan"), float("nan")
    means = values[np.random.default_rng(seed).integers(0, len(values), size=(n, len(values)))].mean(axis=1)
    lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(lo), float(hi)


def bootstrap_by(scores: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, n, mean, low, high); a group is one evaluation run's rows of a category."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(dtype=float)
        lo, hi = bootstrap_interval(v)
        return pd.DataFrame([(key[0], len(v), v.mean() if len(v) else None, lo, hi)], columns=[group, "n", "mean", "low", "high"])

    return scores.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} string, n bigint, mean double, low double, high double")


def paired_difference(a: DataFrame, b: DataFrame, value: str = "correct") -> DataFrame:
    """(category, n, difference, low, high, verdict) of two runs joined on qid, by category and overall (category 'overall').

    Questions without a value in either run are left out. Fewer than MIN_PAIRS pairs: no interval. Resamples are drawn in
    the order of qid from numpy's default generator, seed 0.
    """
    j = a.select("qid", F.coalesce("category", F.lit("unknown")).alias("category"), F.col(value).alias("x")).join(b.select("qid", F.col(value).alias("y")), "qid").withColumn("d", F.col("x") - F.col("y")).where("d is not null")
    both = j.withColumn("category", F.explode(F.array("category", F.lit("overall"))))
    ci = bootstrap_by(both, "category", "d", "qid")
    sure = F.col("n") >= MIN_PAIRS
    return ci.select(
        "category", "n", F.col("mean").alias("difference"), F.when(sure, F.col("low")).alias("low"), F.when(sure, F.col("high")).alias("high"),
        F.when(~sure, f"too few pairs (<{MIN_PAIRS})").when(F.col("low") > 0, "A better").when(F.col("high") < 0, "B better").otherwise("no clear difference").alias("verdict"))


def leaders(scores: DataFrame) -> DataFrame:
    """(category, leader, mean, runner_up, clear): the run of the greatest mean by category and 'overall'; null at an exact tie.

    clear: the paired difference to the runner-up excludes 0, by the interval of paired_difference. Runs are few, and
    every pair of runs that leads and follows somewhere is compared once a category.
    """
    s = scores.withColumn("category", F.explode(F.array(F.coalesce("category", F.lit("unknown")), F.lit("overall"))))
    m = s.groupBy("category", "run_id").agg(F.avg("correct").alias("mean"))
    ranked = m.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), "run_id"))).alias("r"))  # a row a run
    top = ranked.select("category", F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"))
    top = top.select("category", F.col("a.run_id").alias("leader"), (-F.col("a.m")).alias("mean"), F.col("b.run_id").alias("runner_up"), F.coalesce(F.col("a.m") == F.col("b.m"), F.lit(False)).alias("tie"))
    x = s.select("category", "qid", F.col("run_id").alias("leader"), F.col("correct").alias("x"))
    y = s.select("category", "qid", F.col("run_id").alias("runner_up"), F.col("correct").alias("y"))
    d = top.where("not tie").join(x, ["category", "leader"]).join(y, ["category", "runner_up", "qid"]).select("category", "qid", (F.col("x") - F.col("y")).alias("d"))
    ci = bootstrap_by(d, "category", "d", "qid").select("category", ((F.col("n") >= MIN_PAIRS) & (F.col("low") > 0)).alias("clear"))
    return top.join(ci, "category", "left").select("category", F.when(~F.col("tie"), F.col("leader")).alias("leader"), "mean", F.when(~F.col("tie"), F.col("runner_up")).alias("runner_up"), F.coalesce("clear", F.lit(False)).alias("clear"))


def run_list(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with the number of their results, newest first by rank."""
    n = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_results"))
    r = runs.join(n, "run_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("bigint")))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("finished_at", "started_at").desc_nulls_last(), "run_id")))  # runs are few


def default_runs(listed: DataFrame, split: str | None = None) -> DataFrame:
    """(pipeline, run_id): each pipeline's newest run with results, of the split if it has one there."""
    order = F.struct((F.col("split") == split).cast("int").alias("s") if split else F.lit(0).alias("s"), (-F.col("rank")).alias("r"))
    return listed.where("n_results > 0").groupBy("pipeline").agg(F.max_by("run_id", order).alias("run_id"))


def question_table(scores: DataFrame, results: DataFrame, pipelines: list[str]) -> DataFrame:
    """(qid, <pipeline>_correct, <pipeline>_label, <pipeline>_answer for each pipeline): runs side by side; missing cells null."""
    cells = scores.join(results.select("run_id", "qid", "pipeline", "answer_short"), ["run_id", "qid"])
    return cells.groupBy("qid").pivot("pipeline", pipelines).agg(F.max("correct").alias("correct"), F.max("failure_label").alias("label"), F.max("answer_short").alias("answer"))


def cached_answers(results: DataFrame, runs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_key, pipeline, run_id, answer_short): of each question's answers that are no error the one of the oldest run."""
    r = results.where("status <> 'error'").join(runs.select("run_id", "started_at"), "run_id").join(questions.select("qid", question_key(F.col("question")).alias("question_key")), "qid")
    return r.groupBy("question_key", "pipeline").agg(F.min(F.struct("started_at", "run_id", "qid", "answer_short")).alias("x")).select("question_key", "pipeline", "x.run_id", "x.answer_short")


def takeaways(summary: DataFrame, baseline: str) -> DataFrame:
    """(run_id, accuracy_ratio, latency_ratio): a run's overall means over the baseline's; null where the baseline's is 0."""
    o = summary.where("overall = 1").select("run_id", "correct_mean", "latency_median_ms")
    b = o.where(F.col("run_id") == baseline).select(F.col("correct_mean").alias("bc"), F.col("latency_median_ms").alias("bl"))
    return o.crossJoin(F.broadcast(b)).select("run_id", F.try_divide("correct_mean", "bc").alias("accuracy_ratio"), F.try_divide("latency_median_ms", "bl").alias("latency_ratio"))  # one row


def usage_by_request(steps: DataFrame) -> DataFrame:
    """Sums of tokens and cost of each request's steps, its model and tool calls; a verify step with tokens is a model call."""
    model = (F.col("kind") == "llm") | ((F.col("kind") == "verify") & (F.col("tokens_in") > 0))
    return steps.groupBy("request_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"), F.count_if(model).alias("llm_calls"), F.count_if(F.col("kind") == "tool").alias("tool_calls"))


def recall_at(ranked: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, hit): 1 if any of a question's gold chunks (query_id, doc_id) is among its first k; questions without gold are left out."""
    found = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return gold.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(0.0)).alias("hit"))

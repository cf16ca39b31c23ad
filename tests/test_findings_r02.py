import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import context, linking, retrieval, units
from ledgermill.plans import reference_context
from ledgermill.session import UNION_PARTITIONING, table


@pytest.mark.parametrize("match", [(), ("company_id", "fiscal_year")])
def test_pruned_keyword_ranking_equals_brute_force(spark, monkeypatch, match):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 40)
    monkeypatch.setattr(retrieval, "OUT_BLOCK", 10)
    rnd = random.Random(7)
    words = [f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(4000)]
    docs = [(f"d{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), rnd.choice(["A", "B", None]), rnd.choice(["FY1", "FY2", None])) for i in range(300)] + [("d900", None, "A", "FY1")]
    qs = [(f"q{i:02d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))), rnd.choice([None, "A", "B", "none"]), rnd.choice([None, "FY1"])) for i in range(30)]
    qs += [("q90", qs[0][1], qs[0][2], qs[0][3]), ("q91", "the", None, None), ("q92", None, None, None)]
    D = spark.createDataFrame(docs, "doc_id string, text string, company_id string, fiscal_year string").repartition(3)
    Q = spark.createDataFrame(qs, "query_id string, query string, company_id string, fiscal_year string")
    k, want = 4, {}
    for qid, query, c, y in qs:
        pool = [(d[0], Counter((d[1] or "").split())) for d in docs if not match or ((c is None or d[2] == c) and (y is None or d[3] == y))]
        n, al = len(pool), sum(t.total() for _, t in pool) / max(1, len(pool))
        scored = []
        for d, tf in pool:
            s = 0.0
            for t in set((query or "").split()) & set(tf):
                df = sum(t in x for _, x in pool)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * tf.total() / al))
            if s > 0:
                scored.append((-round(s, 9), d))
        want[qid] = [(d, -s) for s, d in sorted(scored)[:k]]
    got = defaultdict(list)
    for r in sorted(retrieval.bm25(D, Q, k, match).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.doc_id, r.score))
    assert dict(got) == {q: v for q, v in want.items() if v}


def test_recall_ranks_only_questions_with_gold(spark, data, monkeypatch):
    ranked, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda docs, queries, k: (ranked.append({r.query_id for r in queries.collect()}), bm25(docs, queries, k))[1])
    assert {r.query_id for r in reference_context.a25_recall_at_8(spark, data).collect()} == ranked[0]


def most_rows(df):
    """The most rows that any part of the executed plan gives."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().apply("numOutputRows").value() if p.metrics().contains("numOutputRows") else 0
        return max([own, *map(walk, kids)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_entities_are_found_by_the_rarest_word(spark):
    E = spark.createDataFrame([(f"C:{i}", "company", f"Nubora{i:03d} Steel Limited", None) for i in range(80)], "entity_id string, kind string, canonical_name string, aliases_text string")
    M = spark.createDataFrame([(i, f"Nubora{i:03d} Steel Limited", None) for i in range(80)] + [(90, "Steel Nobody", None), (91, "Lim Nubora00", None)], "mention_no bigint, text string, kind string")
    found = linking.entity_search(M, E)
    assert {(r.mention_no, r.entity_id) for r in found.collect()} == {(i, f"C:{i}") for i in range(80)} | {(91, f"C:{i}") for i in range(10)}
    assert most_rows(linking.entity_search(M, E)) < 1000


def test_facts_are_made_once_for_questions_that_ask_the_same(spark, data):
    facts, askers = reference_context.question_facts(spark, data)
    asks = {r.ask for r in facts.select("ask").distinct().collect()}
    assert 0 < len(asks) < askers.where(askers.ask.isin(*asks)).count()


def test_ranked_facts_equal_a_pass_over_all(spark):
    rnd = random.Random(8)
    rows = [(q, f"e{i:03d}", rnd.choice("ABC"), f"x{i}", float(rnd.randint(1, 6))) for q in ("p", "q") for i in range(90)]
    rows += [("q", f"t{i}{s}", "PARTY_TO", f"txn{i}", float(rnd.randint(1, 6))) for i in range(30) for s in "abcd"[: rnd.randint(1, 4)]]
    got = defaultdict(list)
    for r in sorted(context.ranked_facts(spark.createDataFrame(rows, "query_id string, edge_id string, rel string, dst_id string, score double"), ["B", "PARTY_TO"], 11, 3).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.edge_id)
    for q in ("p", "q"):
        units = defaultdict(list)
        for _, e, rel, dst, s in (r for r in rows if r[0] == q):
            units[dst if rel == "PARTY_TO" else e].append((e, rel, s))
        order = sorted(units.values(), key=lambda u: (-max(x[2] for x in u), min(x[0] for x in u)))
        taken, used = [], 0
        for rel in ("B", "PARTY_TO", None):
            n = 0
            for u in order:
                if u not in taken and rel in (None, u[0][1]) and (rel is None or n < 3) and used + len(u) <= 11:
                    taken, used, n = [*taken, u], used + len(u), n + 1
        assert got[q] == [e for u in order if u in taken for e in sorted(x[0] for x in u)]


def test_chunk_evidence_takes_the_texts_lengths(spark):
    hits = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, rank int")
    chunks = spark.createDataFrame([("d1", "x" * 44), ("d2", "")], "doc_id string, text string")
    assert sorted(map(tuple, context.chunk_evidence(hits, chunks).collect())) == [("q", 1, "d1", 11), ("q", 2, "d2", 1)]


def test_table_turns_union_partitioning_off_where_unset(spark, data):
    before = spark.conf.get(UNION_PARTITIONING)
    spark.conf.unset(UNION_PARTITIONING)
    try:
        table(spark, data, "questions")
        assert spark.conf.get(UNION_PARTITIONING) == "false"
    finally:
        spark.conf.set(UNION_PARTITIONING, before)


def test_equal_questions_are_searched_once(spark, data, monkeypatch):
    filters = reference_context.question_filters
    monkeypatch.setattr(reference_context, "question_filters", lambda s, d: filters(s, d).withColumn("query_id", F.explode(F.array("query_id", F.concat("query_id", F.lit("~"))))))
    _, queries, hits, askers = reference_context._hybrid(spark, data, 3)
    texts = [(r.query, r.company_id, r.fiscal_year) for r in queries.collect()]
    assert len(texts) == len(set(texts)) < askers.count()
    assert {r.query_id for r in hits.collect()} <= {r.query_id for r in askers.collect()}


def test_answers_without_unit_reach_the_mixture(spark):
    rows = [(f"k{i}", "5", "crore", "What was the fee?") for i in range(20)] + [("m", "6", None, "What was the fee?"), ("z", "0", None, "What was the fee?"), ("n", "6", None, "How many were there?"), ("s", "6", "shares", "What was it?")]
    q = spark.createDataFrame([(*r, "number") for r in rows], "qid string, gold_answer string, gold_unit string, question string, answer_type string")
    t = units.answer_amounts(q, spark.createDataFrame([], "currency string, fiscal_year string, inr_per_unit double"))
    got = {r.qid: r for r in t.collect()}
    assert (got["m"].basis, got["m"].factor, got["m"].rupees) == ("mixture", 1e7, 6e7) and got["m"].posterior > 0.9 and not got["m"].uncertain
    assert [got[x].basis for x in "zns"] == [None] * 3 and got["n"].rupees is None and got["s"].rupees is None
    assert units.answers_not_in_crore(t).count() == 0


def test_budget_makes_edges_once(spark, data, monkeypatch):
    made, edges_of = [], reference_context.edges_of
    monkeypatch.setattr(reference_context, "edges_of", lambda s, d: made.append(1) or edges_of(s, d))
    assert reference_context.w14_split_budget(spark, data).count() > 0 and made == [1]


def test_seed_units_leave_the_ranking(spark):
    rnd = random.Random(9)
    edges = [(f"e{i:03d}", rnd.choice("AB"), "h", f"x{i}", rnd.choice(["Y1", "Y2", ""])) for i in range(200)]
    for i in range(60):
        year, ends = rnd.choice(["Y1", "Y2"]), rnd.choice(["h", "o", "ho", "oh"])
        edges += [(f"t{i * 37 % 60:02d}{c}", "PARTY_TO", s, f"txn{i}", year) for c, s in zip("ab", ends)]
    ends = {x: {e[2] for e in edges if x in (e[0], e[3])} for e in edges for x in (e[0], e[3])}
    near = spark.createDataFrame([(s, e, rel, dst, y, [src]) for e, rel, src, dst, y in edges for s in ends[dst]], "seed string, edge_id string, rel string, dst_id string, fiscal_year string, ends array<string>")
    asks = spark.createDataFrame([("p", ["h"], "A", "Y2"), ("q", ["h", "o"], "PARTY_TO", "Y1"), ("r", ["o"], "", None)], "query_id string, seeds array<string>, asked string, year string")
    each = asks.withColumn("seed", F.explode("seeds"))
    score = F.when(F.arrays_overlap("ends", "seeds"), 3.0).otherwise(0.0) + F.when(F.col("rel") == F.col("asked"), 2.0).otherwise(0.0) + F.when(F.col("fiscal_year") == F.col("year"), 1.5).otherwise(0.0)
    units = context.seed_units(near, F.col("ends"), 7).join(each, "seed").where(context.takeable(F.col("year"), F.col("seeds"), 7))
    some = units.select("query_id", "asked", "year", "seeds", F.explode("edges").alias("x")).select("*", "x.*")
    assert some.count() == some.select("query_id", "edge_id").distinct().count() < near.join(each, "seed").count() / 2
    want, got = (sorted(map(tuple, context.ranked_facts(f.select("query_id", "edge_id", "rel", "dst_id", score.alias("score")).distinct(), ["B"], 7, 2).collect())) for f in (near.join(each, "seed"), some))
    assert got == want and {r[0] for r in got} == {"p", "q", "r"}


def test_common_terms_are_added_up_once():
    class Post(dict):
        seen = Counter()

        def __getitem__(self, t):
            self.seen[t] += 1
            return super().__getitem__(t)

    n, lists = 400, [["rare", f"w{i}", "of", "the"] for i in range(50)]
    post = Post({t: (np.arange(at, n, step), np.full(len(range(at, n, step)), w)) for t, at, step, w in [("the", 0, 1, 0.1), ("of", 1, 2, 0.2), ("rare", 7, 100, 3.0), *[(f"w{i}", i, 40, 1.0) for i in range(50)]]})
    edge = retrieval._common_from(lists, {t: len(rows) for t, (rows, _) in post.items()}, n)
    asking = [(i, i, tuple(t for t in ts if len(post[t][0]) > edge), tuple(t for t in ts if len(post[t][0]) <= edge)) for i, ts in enumerate(lists)]
    Post.seen.clear()
    for i, _, rows, scores in retrieval._best(asking, post, n, 6, np.zeros(50)):
        every = np.zeros(n)
        for t in lists[i]:
            every[dict.__getitem__(post, t)[0]] += dict.__getitem__(post, t)[1]
        order = np.lexsort((np.arange(n), -every.round(9)))[:6]
        assert (list(rows), list(scores)) == (list(order), list(every.round(9)[order]))
    assert (Post.seen["the"], Post.seen["of"], Post.seen["rare"]) == (1, 1, 50)

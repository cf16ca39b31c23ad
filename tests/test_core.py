"""Operators outside the llm subpackage against brute force and SQL."""

import json
import random
from collections import Counter, defaultdict

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.functions import amounts, fuzzy, text
from ledgermill.operators import evaluation, graph, retrieval, skew, units
from ledgermill.plans import registry
from ledgermill.session import scratch
from ledgermill.sources import readers, writers
from ledgermill.streaming import usage


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_naive():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 25))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == naive_lcs(a, b)
    assert fuzzy.sorted_ratio("rao asha", "asha rao") == 100 and fuzzy.set_ratio("asha rao", "asha k rao") == 100 and fuzzy.partial_ratio("abc", "xxabcxx") == 100


def test_profile_equals_brute_force_with_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), f"m{rnd.randint(0, 40)}" if rnd.random() < 0.9 else None, rnd.choice(["x", "y", None]), rnd.choice([1, 2, 3, None]), i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, mention_id string, method string, logged_at int, log_id int").withColumn("salt", F.lit(1)).withColumn("n", F.lit(2))
    got = {(r.key_field, r.key_value): (r.n_rows, r.n_counterparts) for r in skew.salted_profile(df, ["entity_id", "mention_id"], "method", ["logged_at", "log_id"], parts=5).collect()}
    n, other = Counter(), defaultdict(set)
    for e, m, *_ in rows:
        for k, v, o in (("entity_id", e, m), ("mention_id", m, e)):
            if v is not None:
                n[k, v] += 1
                other[k, v] |= {o} - {None}
    assert got == {k: (n[k], len(other[k])) for k in n}
    assert skew.salted_profile(df.limit(0), ["entity_id", "mention_id"], "method", ["logged_at", "log_id"]).count() == 0


def test_skew_join_equals_plain_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(500)] + [("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("h", "H"), ("a", "A"), ("c", "C")], "k string, y string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.skew_join_unique(left, right, "k", how).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    with pytest.raises(ValueError):
        skew.skew_join_unique(left, right, "k", "outer")


@pytest.mark.parametrize("raw, value", [
    ("Rs. 15 Cr 26 Lacs", 152600000), ("INR 7,519,000", 7519000), ("₹ 22,10,00,000", 221000000), ("H184.68 Lac", 18468000), ("₹ lakhs: 1682.79", 168279000), ("2,026.00 (₹ lakhs)", 202600000),
    ("₹ '000: 69.1", 69100), ("INR 1244.1 000s", 1244100), ("Rs. 27,70,000/-", 2770000), ("Rupees Fifty-five crore Eighty lakh only", 558000000), ("47.51*", None), ("7 (a)", None), ("USD 49 bn", 49e9), (None, None), ("", None)])
def test_printed_amounts(raw, value):
    a = amounts.read_amount(raw)
    got = None if a.value is None or a.factor is None else a.value * a.factor
    assert got is None if value is None else got == pytest.approx(value)


def test_misstated_transactions(spark):
    def rec(i, inr, raw, note, **k):
        return (f"r{i}", "rpt", json.dumps({"amount_inr": inr, "amount_raw": raw, "fiscal_year": "FY2022-23", "evidence": {"quote": f"A | B | {raw} {note}"}} | k))

    rows = [rec(1, 5e7, "₹ 5 crore", ""), rec(2, 5.0, "₹ 5 crore", ""), rec(3, 13.0, "13*", "(Rs. in lakhs)"), rec(4, 7.0, "7", ""), rec(5, None, "₹ 5 crore", ""), rec(6, 8.03e8, "USD 10 million", ""),
            ("r7", "rpt", "broken"), ("r8", "rpt", None), rec(2, 5.0, "₹ 5 crore", "")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, payload_json string").withColumn("rate", F.lit(1))
    fx = spark.createDataFrame([("USD", "FY2022-23", 80.3)], "currency string, fiscal_year string, inr_per_unit double")
    t = units.transaction_amounts(df, fx)
    assert {r.record_id for r in units.misstated_transactions(t).collect()} == {"r2", "r3"}
    assert {r.record_id: r.basis for r in t.collect()}["r4"] == "mixture"
    assert units.transaction_amounts(df.limit(0), fx).count() == 0


@pytest.mark.parametrize("quote, factor", [
    ("(Rs. in lakhs) A Limited | Sale of services | 121.00*", 1e5), ("All amounts in INR million unless otherwise stated A | Dividend paid | 32.00", 1e6), ("(₹ in '000) A | Loan given | 5", 1e3),
    ("(Amounts in whole rupees) A | Rent paid | 5 (a)", 1.0), ("Amount in Rs. Cr Million Steel | Rent paid | 5", 1e7), ("(₹ in crore) A | Rent paid | 5 (Rs. in lakhs)", 1e5),
    ("Million Crore Steel Limited | Rent paid | 5", None), ("(India) Million Steel | Rent paid | 5", None), ("A | Loan in crore | 5", None), (None, None)])
def test_note_of_a_quote(quote, factor):
    assert units.note_unit(quote)[0] == factor


def test_front_note_states_the_unit(spark):
    def rec(i, inr, quote):
        return (f"r{i}", "rpt", json.dumps({"amount_inr": inr, "amount_raw": "13", "fiscal_year": "FY2022-23", "evidence": {"quote": quote}}))

    rows = [rec(1, 13.0, "(Rs. in lakhs) A Limited | Rent paid | 13"), rec(2, 13e6, "All amounts in INR million unless otherwise stated A | Rent paid | 13"), rec(3, 13.0, "A | Rent paid | 13")]
    fx = spark.createDataFrame([], "currency string, fiscal_year string, inr_per_unit double")
    t = units.transaction_amounts(spark.createDataFrame(rows, "record_id string, record_type string, payload_json string"), fx)
    assert {r.record_id: r.basis for r in t.collect()} == {"r1": "quote", "r2": "quote", "r3": "mixture"}
    assert [r.record_id for r in units.misstated_transactions(t).collect()] == ["r1"]


def test_answers_in_crore(spark):
    rows = [("q1", "5 crore", None, "?", "number"), ("q2", "5", "lakh", "?", "number"), ("q3", "5", None, "What was it, in INR million?", "number"), ("q4", "5", "shares", "How many?", "number"), ("q5", None, "crore", "?", "number"), ("q6", "5", None, "?", "number")]
    q = spark.createDataFrame(rows, "qid string, gold_answer string, gold_unit string, question string, answer_type string")
    fx = spark.createDataFrame([], "currency string, fiscal_year string, inr_per_unit double")
    a = units.answer_amounts(q, fx)
    assert {r.qid for r in units.answers_not_in_crore(a).collect()} == {"q2", "q3"}
    assert {r.qid: r.crore for r in a.collect()}["q3"] == pytest.approx(0.5)


def test_two_hops_equals_brute_force(spark):
    rnd = random.Random(3)
    es = [(f"e{i}", "R", f"v{rnd.randint(0, 30)}", f"v{rnd.randint(0, 30)}", rnd.choice([None, "FY2021-22"])) for i in range(80)]
    edges = spark.createDataFrame(es, "edge_id string, rel string, src_id string, dst_id string, fiscal_year string").withColumn("src_type", F.lit("Person")).withColumn("dst_type", F.lit("Company"))
    seeds, hub = {"v1", "v2"}, {"v3"}
    got = {r.edge_id: r.hop for r in graph.two_hops(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), spark.createDataFrame([("v3", 9)], "entity_id string, degree int")).collect()}
    one = {e[0] for e in es if {e[2], e[3]} & seeds}
    frontier = {v for e in es if e[0] in one for v in (e[2], e[3])} - seeds - hub
    two = {e[0] for e in es if (e[2] in frontier and e[3] not in hub) or (e[3] in frontier and e[2] not in hub)}
    assert got == {e: 1 if e in one else 2 for e in one | two}


def test_budget_skips_what_does_not_fit(spark):
    rnd = random.Random(4)
    rows = [(q, r, rnd.randint(1, 900), f"d{q}{r}") for q in "ab" for r in range(1, 30)]
    got = {(r.query_id, r.doc_id, r.label) for r in retrieval.fit_budget(spark.createDataFrame(rows, "query_id string, rank int, tokens int, doc_id string"), "query_id", "rank", "tokens", 2000).collect()}
    want = set()
    for q in "ab":
        used, k = 0, 0
        for _, r, t, d in sorted(x for x in rows if x[0] == q):
            if used + t + 30 <= 2000:
                used, k = used + t + 30, k + 1
                want.add((q, d, f"E{k}"))
    assert got == want


def test_bootstrap_is_numpys(spark):
    v = np.array([0, 1, 1, 0, 1, 1, 1.0])
    rows = [(f"q{i}", "c", float(x)) for i, x in enumerate(v)]
    r = evaluation.bootstrap_by(spark.createDataFrame(rows, "qid string, category string, correct double"), "category", "correct", "qid").collect()[0]
    assert (r.low, r.high) == evaluation.bootstrap_interval(v)
    a = spark.createDataFrame(rows, "qid string, category string, correct double")
    got = {r.category: r for r in evaluation.paired_difference(a, a).collect()}
    assert set(got) == {"c", "overall"} and got["c"].verdict == "no clear difference" and got["c"].low == 0
    b = spark.createDataFrame([(f"q{i}", "c", 0.0 if i else None) for i in range(4)], a.schema)
    few = {r.category: r for r in evaluation.paired_difference(a, b).collect()}
    assert few["overall"].n == 3 and few["overall"].low is None and few["overall"].verdict.startswith("too few")


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"qid": "a", "question": "x"}\nbroken\n{"qid": "b"}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "q.jsonl"), readers.QUESTION, tolerant=True).count() == 2
    (tmp_path / "o.csv").write_text("id,name\n1,x\n")
    assert readers.read_csv(spark, str(tmp_path / "o.csv"), "id int, name string").collect()[0].name == "x"
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "ABC_annual_report_FY2022-23.pdf").write_bytes(b"%PDF one")
    (inbox / "ABC_regulatory_order.pdf").write_bytes(b"%PDF two")
    (inbox / "bad_annual_report.pdf").write_bytes(b"no pdf")
    got = {(r.company_id, r.doc_type, r.fiscal_year) for r in readers.read_inbox(spark, str(inbox)).collect()}
    assert got == {("ABC", "annual_report", "FY2022-23"), (None, "regulatory_order", None)}
    a = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (3, "add")], "k int, v string")
    assert {tuple(r) for r in writers.upserted(a, b, ["k"]).collect()} == {(1, "new"), (2, "keep"), (3, "add")}
    assert {tuple(r) for r in writers.inserted_if_absent(a, b, ["k"]).collect()} == {(1, "old"), (2, "keep"), (3, "add")}
    writers.write_edges(spark.createDataFrame([("e", "R", "a", "b")], "edge_id string, rel string, src_id string, dst_id string"), str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 1


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    s = usage.stream_usage(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("usage_out").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.window_start), r.event_type, r.n)
    assert sorted(map(key, spark.table("usage_out").collect())) == sorted(map(key, usage.windowed_usage(src).collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([("Mr. A  K Rao", "Firm & Co (India) Pvt. Ltd.", "FY2023-24", "the net profit of A")], "p string, c string, fy string, q string")
    r = df.select(text.norm_person(F.col("p")).alias("p"), text.norm_company(F.col("c")).alias("c"), text.fiscal_year_end(F.col("fy")).alias("fy"), text.keyword_tokens(F.col("q")).alias("q"), text.nfkc(F.lit("ﬁn")).alias("n"), text.crore_text(F.lit(482000000.0)).alias("cr")).collect()[0]
    assert (r.p, r.c, str(r.fy), r.q, r.n, r.cr) == ("a k rao", "firm and", "2024-03-31", ["net", "profit"], "fin", "₹ 48.20 crore")


def _plain(v):
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for _, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple(_plain(x) for _, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    try:
        return float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        return str(v)


def test_every_query_runs_and_equals_its_sql(spark, data):
    db = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, f in registry.QUERIES.items():
        with scratch(spark):
            df = f(spark, data)
            cols = sorted(df.columns)
            got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        if name in registry.ORACLE_SQL:
            out = db.execute(registry.ORACLE_SQL[name])
            place = [[c[0] for c in out.description].index(c) for c in cols]
            want = sorted((tuple(_plain(r[i]) for i in place) for r in out.fetchall()), key=repr)
            assert got == want, name
    assert registry.flagship(spark, data).count() > 0


def test_grounding_repairs_the_page(spark):
    from ledgermill.operators import evidence

    def rec(i, page, quote):
        return (f"r{i}", json.dumps({"evidence": {"doc_id": "d", "page": page, "quote": quote}}))

    pages = spark.createDataFrame([("d", 4, "The “first”  page text", None), ("d", 5, None, "second page\ntext"), ("d", 5, None, "second page\ntext"), ("e", 5, "third page text", None)], "doc_id string, page_no int, cleaned_text string, text string")
    rows = [rec(1, 5, "second page text"), rec(2, 5, 'the "first" page'), rec(3, 3, "the \"first\" page"), rec(4, 5, "third page text"), rec(5, 5, "page"), ("r6", "broken"), ("r7", None)]
    got = {r.record_id: r.found_on for r in evidence.grounded_pages(spark.createDataFrame(rows, "record_id string, payload_json string"), pages).collect()}
    assert got == {"r1": 5, "r2": 4, "r3": 4, "r4": None, "r5": None}


def test_distances_equal_brute_force(spark):
    rnd = random.Random(8)
    es = [(f"e{i}", "R", f"v{rnd.randint(0, 40)}", f"v{rnd.randint(0, 40)}") for i in range(45)]
    got = {r.id: r.hops for r in graph.distances(spark.createDataFrame(es, "edge_id string, rel string, src_id string, dst_id string"), spark.createDataFrame([("v1",)], "id string"), 3).collect()}
    want, front = {"v1": 0}, {"v1"}
    for hop in (1, 2, 3):
        front = {y for _, _, a, b in es for x, y in ((a, b), (b, a)) if x in front} - set(want)
        want |= {v: hop for v in front}
    assert got == want

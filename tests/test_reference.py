"""Operators whose queries have no SQL, against brute force and cases."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.functions import answers, fuzzy, text
from ledgermill.operators import chunking, context, documents, evaluation, graph, linking, records, resolve, retrieval
from ledgermill.sources import readers, writers


@pytest.mark.parametrize("kind, given, gold, score", [
    ("entity", "M/s Rao & Mehta LLP", "Rao and Mehta", 1.0), ("entity", "Tata Steel", "Tata Power", 0.0), ("entity", "", "Tata", 0.0), ("entity", None, "Tata", 0.0), ("entity", "Limited", "Limited", 0.0),
    ("yes_no", "Yes, it did.", "yes", 1.0), ("yes_no", "", "yes", 0.0), ("yes_no", "It did", "yes", 0.0), ("number", "₹ 1,25,00,000", "1.25", 1.0), ("number", "125 lakh", "1.25", 1.0), ("number", "1.3 crore", "1.25", 0.0),
    ("number", "none", "1.25", 0.0), ("list", "Asha Rao; Ravi Kumar", "Ravi Kumar\nAsha Rao", 1.0), ("list", "Asha Rao", "Ravi Kumar; Asha Rao", 2 / 3), ("list", "", "", 1.0), ("list", "", "x y", 0.0), ("not_found", "x", "x", None)])
def test_scores_of_answers(spark, kind, given, gold, score):
    df = spark.createDataFrame([(kind, given, gold)], "k string, p string, g string")
    got = df.select(answers.score_answer(F.col("k"), F.col("p"), F.col("g")).alias("s")).collect()[0].s
    assert got is None if score is None else got == pytest.approx(score)


def test_labels_of_failures(spark):
    rows = [("error", 0.0, True, None, None, "entity", "bad_query"), ("budget", 0.0, False, None, None, "entity", "budget_loop"), ("abstained", 1.0, False, None, None, "not_found", None), ("ok", 0.0, False, None, None, "not_found", "hallucination"),
            ("abstained", 0.0, True, None, 0.0, "number", "wrong_abstention"), ("ok", 1.0, True, 0.5, 1.0, "entity", "hallucination"), ("ok", 1.0, True, None, 0.0, "entity", None), ("ok", 0.0, True, 1.0, 0.0, "number", "retrieval_miss"),
            ("ok", 0.0, True, None, 1.0, "number", "arithmetic_error"), ("ok", 0.0, True, None, None, "number", "arithmetic_error"), ("ok", 0.0, True, None, None, "entity", "retrieval_miss"), ("ok", 0.0, True, None, 1.0, "entity", "hallucination"), ("budget", 1.0, True, None, 1.0, "entity", None)]
    df = spark.createDataFrame(rows, "s string, c double, a boolean, f double, r double, k string, want string")
    got = df.withColumn("got", evaluation.failure_label(*[F.col(c) for c in "scafrk"[:1] + "cafrk"])).collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize("question, names", [
    ("Who is the Chairman of Tata Steel Limited in FY2022-23?", ["Chairman of Tata Steel Limited"]), ("Did Mr. Rao audit M&M Finance and Bajaj Holdings?", ["Rao", "M&M Finance and Bajaj Holdings"]), ("Which companies?", []), ("What is Asha's role?", ["Asha"]), ("", [])])
def test_capital_phrases(question, names):
    assert answers.capital_phrases(question) == names


def test_calculator():
    assert answers.calculate("round((48.2 + 1.8) / 4, 1) * -2") == -25.0 and answers.calculate("sum([1, 2, 3]) % 4 + max(2, 3) ** 2") == 11
    for bad in ("", "x + 1", "__import__('os')", "2 ** 11", "9 ** 9 ** 9", "'a' * 3", "[1]", "True", "1 if 1 else 2", "round(1, ndigits=2)", "(" * 3, "1" * 600):
        with pytest.raises(ValueError):
            answers.calculate(bad)


def test_numbers_supported_and_claims(spark):
    rows = [("₹ 12.5 crore", "paid 12.50 crore", True), ("125 million", "it was 12.5", True), ("7", "it was 8", False), ("none", "", True), ("7", None, False)]
    got = spark.createDataFrame(rows, "a string, e string, want boolean").withColumn("got", answers.number_supported(F.col("a"), F.col("e"))).collect()
    assert all(r.got == r.want for r in got)
    assert answers.repaired_records('{"records": [{"evidence": {"page": "[PAGE 45]"}}, {"evidence": {"page": 3, "doc_id": "x"}}, {"evidence": null}, 5]}', "d") == [{"evidence": {"doc_id": "d", "page": 45}}, {"evidence": {"doc_id": "x", "page": 3}}, {"evidence": None}, 5]


def test_pieces_and_packing():
    rnd = random.Random(1)
    for _ in range(200):
        t = "\n".join("".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 3, 20, 90]))) for _ in range(rnd.randint(1, 8)))
        pieces = chunking.pieces_of(t, 8)
        assert all(len(p) <= 35 for p in pieces) and all(p.strip() for p in pieces if len(t) > 35)
        assert "".join("".join(pieces).split()) == "".join(t.split())
        sizes = [rnd.randint(1, 9) for _ in range(rnd.randint(0, 30))]
        spans = chunking.packed(sizes, 12, 4)
        assert sorted({i for a, b in spans for i in range(a, b + 1)}) == list(range(len(sizes)))
        for (a, b), (c, _) in zip(spans, spans[1:]):
            assert c <= b + 1 and sum(sizes[c : b + 1]) <= 4 and sum(sizes[a : b + 2]) > 12


def test_chunks_of_pages_and_tables(spark):
    rows = [("d" * 64, p, "\n\n".join(f"paragraph {p} {i} " + "word " * 150 for i in range(4))) for p in range(1, 8)] + [("e" * 64, 1, "short")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    secs = spark.createDataFrame([(d, p, "notes" if p < 4 else "other") for d, p, _ in rows], "doc_id string, page_no int, kind string")
    got = chunking.text_chunks(pages, secs).collect()
    assert all(r.token_count <= chunking.MAX_TOKENS + 10 for r in got) and {r.section for r in got} == {"notes", "other"}
    for r in rows:
        for para in r[2].split("\n\n"):
            assert any(para.strip() in c.text and c.doc_id == r[0] for c in got)
    assert min(r.chunk_id for r in got if r.section == "notes") == "dddddddddddd-notes-0001" and not any(r.page_start < 4 <= r.page_end for r in got if r.doc_id[0] == "d")
    cells = [("d" * 64, 2, 0, r, c, f"{'head' if r == 0 else 'cell'} {r} {c} " + "x" * 60) for r in range(60) for c in range(2)] + [("d" * 64, 5, 0, 0, 0, "tiny")]
    t = chunking.table_chunks(spark.createDataFrame(cells, "doc_id string, page_no int, table_idx int, row int, col int, text string"), secs).collect()
    assert len(t) > 1 and all(x.text.startswith("head 0 0") and x.token_count <= 800 for x in t) and sum(x.text.count("cell") for x in t) == 118


def test_shareholding_tables():
    def table(*lines):
        return [{"row": i, "col": j, "text": x} for i, line in enumerate(lines) for j, x in enumerate(line)]

    good = table(["Table A", ""], ["Name of shareholder", "% of total shares", "% pledged"], ["Promoter group", "51.2%", "nil"], ["Asha Rao", "1,000.5", "-"], ["Total", "100", ""])
    got = chunking.shareholding_rows(good)
    assert [(r["holder_name"], r["holder_kind"], r["pct_holding"], r["pct_pledged"]) for r in got] == [("Promoter group", "category", 51.2, 0.0), ("Asha Rao", "person", 1000.5, 0.0)]
    assert chunking.shareholding_rows(table(["Name", "Shares"], ["x", "1"])) is None and chunking.shareholding_rows(table(["Name", "% of total"], ["x", "?"], ["y", "1"])) is None and chunking.shareholding_rows([]) is None


def test_candidate_pairs_equal_brute_force(spark, monkeypatch):
    from ledgermill.operators import skew

    monkeypatch.setattr(skew, "PART", 5)
    rnd = random.Random(3)
    given, last = ["asha", "ashaa", "a", "ravi", "r k", "ravi kumar"], ["rao", "raoo", "sharma"]
    rows = [("person", f"{rnd.choice(given)} {rnd.choice(last)}", {"din": str(rnd.randint(1, 3))} if rnd.random() < 0.5 else rnd.choice([{}, None])) for _ in range(60)]
    rows += [("company", f"nubora steel {x}", {}) for x in ("works", "work", "power", "")] + [("audit_firm", f"mehta {x}", {"frn": "9"}) for x in ("and sons", "and son")] + [("person", None, None), ("person", "", {})]
    classes = sorted({(k, n, ",".join(f"{a}={b}" for a, b in (i or {}).items())) for k, n, i in rows if n})

    def block(k, n):
        w = n.split(" ")
        return (k, w[-1] if k == "person" else " ".join(w[:2]) if k == "company" else w[0])

    want = set()
    for (k, n, i), (k2, m, j) in itertools.combinations(classes, 2):
        if block(k, n) != block(k2, m) or (i and j and i.split("=")[0] == j.split("=")[0] and i != j):
            continue
        x, y = ({w[0] for w in z.split() if w} for z in (n, m))
        score = 100.0 if n == m else 0.0 if k == "person" and not (x <= y or y <= x) else round(fuzzy.sorted_ratio(n, m), 4)
        if score >= 80:
            want.add((k, n, i, m, j, score, "exact_name" if n == m else "fuzzy" if score >= 95 else "review_queue"))
    df = spark.createDataFrame(rows, "kind string, norm_name string, ids map<string,string>")
    assert {tuple(r) for r in resolve.candidate_pairs(df.unionByName(df)).collect()} == want and want


def test_hybrid_search_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["loan", "auditor", "steel", "board", "pledge", "rent", "power"]
    docs = [(f"d{i:02d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))), rnd.choice(["A", "B", None]), rnd.choice(["FY1", "FY2", None])) for i in range(60)]
    qs = [(f"q{i}", " ".join(rnd.sample(words, 2)), rnd.choice([None, "A", "B"]), rnd.choice([None, "FY1"])) for i in range(12)] + [("q97", "the of", None, None), ("q98", "steel", "none", None)]
    embed = retrieval.hashed_embedding(16)
    D = spark.createDataFrame(docs, "doc_id string, text string, company_id string, fiscal_year string").withColumn("embedding", embed("text"))
    Q = spark.createDataFrame(qs, "query_id string, query string, company_id string, fiscal_year string").withColumn("embedding", embed("query"))
    vec = {r[0]: np.array(r[1]) for df, k in ((D, "doc_id"), (Q, "query_id")) for r in df.select(k, "embedding").collect()}
    k, want = 5, {}
    for qid, query, c, y in qs:
        pool = [d for d in docs if (c is None or d[2] == c) and (y is None or d[3] == y)]
        near = sorted(((-round(float(vec[qid] @ vec[d[0]]), 9), d[0]) for d in pool))[: 3 * k]
        terms = {w for w in query.split() if w not in text.STOP_WORDS}
        n, al = len(pool), sum(len(d[1].split()) for d in pool) / max(1, len(pool))
        scored = []
        for d in pool:
            tf, s = Counter(d[1].split()), 0.0
            for t in terms & set(tf):
                df = sum(t in x[1].split() for x in pool)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d[1].split()) / al))
            if s > 0:
                scored.append((-round(s, 9), d[0]))
        total, first = defaultdict(float), {}
        for ranking in (near, sorted(scored)[: 3 * k]):
            for r, (_, d) in enumerate(ranking, 1):
                total[d] += 1 / (60 + r)
                first[d] = min(first.get(d, 99), r)
        want[qid] = [d for _, _, d in sorted((-round(s, 9), first[d], d) for d, s in total.items())[:k]]
    got = defaultdict(list)
    for r in sorted(retrieval.hybrid_search(D, Q, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.doc_id)
    assert dict(got) == {q: v for q, v in want.items() if v}


def test_linking(spark):
    ents = [("C:TS", "company", "Nubora Steel Limited", "Nubora Steel Co|NSL", 1), ("C:TP", "company", "Nubora Power Limited", None, 2), ("P:1", "person", "Asha K Rao", "A K Rao", 3), ("P:2", "person", "Asha Rao", None, 4), ("A:1", "audit_firm", "Mehta & Sons", None, 5)]
    E = spark.createDataFrame(ents, "entity_id string, kind string, canonical_name string, aliases_text string, row_id int")
    m = [("q1", 0, "Nubora Steel", None), ("q1", 1, "Nubora Steel Limited", "company"), ("q2", 0, "Asha Rao", "person"), ("q2", 1, "Mehta Sons", "company"), ("q3", 0, "Nobody Here", None), ("q3", 1, '"; drop *', None)]
    M = spark.createDataFrame(m, "query_id string, pos int, text string, kind string")
    got = {(r.query_id, r.entity_id): r.status for r in linking.link_questions(M, E).collect()}
    assert got == {("q1", "C:TS"): "linked", ("q2", "P:1"): "ambiguous", ("q2", "P:2"): "ambiguous", ("q2", "A:1"): "linked"}
    found = linking.entity_search(spark.createDataFrame([(1, "nub ste", None), (2, "nubora", "company")], "mention_no bigint, text string, kind string"), E).collect()
    assert {(r.mention_no, r.entity_id) for r in found} == {(1, "C:TS"), (2, "C:TS"), (2, "C:TP")}


def test_facts_are_ranked_in_units(spark):
    rnd = random.Random(6)
    rows = [("q", f"e{i:02d}", rnd.choice(["A", "B"]), f"x{i}", float(rnd.randint(1, 5))) for i in range(20)] + [("q", f"t{i}{s}", "PARTY_TO", f"txn{i}", float(rnd.randint(1, 5))) for i in range(4) for s in "ab"]
    got = [r.edge_id for r in sorted(context.ranked_facts(spark.createDataFrame(rows, "query_id string, edge_id string, rel string, dst_id string, score double"), ["B"], 9, 3).collect(), key=lambda r: r.rank)]
    units = defaultdict(list)
    for _, e, rel, dst, s in rows:
        units[dst if rel == "PARTY_TO" else e].append((e, rel, s))
    order = sorted(units.values(), key=lambda u: (-max(x[2] for x in u), min(x[0] for x in u)))
    taken, used = [], 0
    for wanted in ("B", None):
        n = 0
        for u in order:
            if u not in taken and (wanted is None or (u[0][1] == wanted and n < 3)) and used + len(u) <= 9:
                taken.append(u)
                used, n = used + len(u), n + 1
    assert got == [e for u in order if u in taken for e in sorted(x[0] for x in u)]


def test_budget_is_split(spark):
    rnd = random.Random(7)
    P = [("q", i, rnd.randint(10, 300), f"p{i}") for i in range(1, 9)]
    S = [(q, i, rnd.randint(10, 300), f"s{i}") for q in ("q", "r") for i in range(1, 9)]
    schema = "query_id string, rank int, tokens int, ref_id string"
    got = defaultdict(list)
    for r in sorted(context.split_budget(spark.createDataFrame(P, schema), spark.createDataFrame(S, schema), 900, 0.5).collect(), key=lambda r: (r.query_id, int(r.label[1:]))):
        got[r.query_id].append(r.ref_id)

    def fit(items, room):
        out, used = [], 0
        for _, _, t, x in items:
            if used + t + 30 <= room:
                out.append(x)
                used += t + 30
        return out, used

    first, used = fit(P, 450)
    assert got["q"] == first + fit([x for x in S if x[0] == "q"], 900 - used)[0] and got["r"] == fit([x for x in S if x[0] == "r"], 900)[0]
    items = spark.createDataFrame([("q", 1, 400, "a", False, True, 0.1), ("q", 2, 400, "b", True, False, 0.0), ("q", 3, 400, "c", False, False, 0.9)], "query_id string, n int, tokens int, ref_id string, cited boolean, recent boolean, relevance double")
    assert [r.ref_id for r in sorted(context.prioritized(items, 900).collect(), key=lambda r: r.label)] == ["b", "c"] and context.prioritized(items, 2000).count() == 3


def test_citations_and_texts(spark):
    ev = spark.createDataFrame([("q", "E1", "the board met on Monday in Velapuri", "d", 3, 4), ("q", "E2", "other words", "d", 7, 7)], "query_id string, label string, text string, doc_id string, page_start int, page_end int")
    pages = spark.createDataFrame([("d", 3, "x"), ("d", 4, "the board met on Monday in Velapuri"), ("d", 7, "y")], "doc_id string, page_no int, text string")
    cit = spark.createDataFrame([("q", 1, "E1", "board met"), ("q", 2, "E1", "board mett on Monday in Velapuri"), ("q", 3, "E2", "nowhere said so"), ("q", 4, "E7", "x"), ("q", 5, "E2", None)], "query_id string, n int, label string, quote string")
    got = {r.n: (r.status, r.page) for r in context.resolved_citations(cit, ev, pages).collect()}
    assert got == {1: ("ok", 4), 2: ("ok", 3), 3: ("quote_not_found", 7), 4: ("unknown_label", None), 5: ("quote_not_found", 7)}
    cols = "edge_id string, rel string, src_id string, src_type string, dst_id string, dst_type string, role string, independent boolean, start_date string, end_date string, fiscal_year string, pct_held double, as_of string, doc_id string, page int, quote string, amount_inr double, nature string, relationship string"
    e = [("a", "PARTY_TO", "C:1", "Company", "t", "RelatedPartyTxn", "reporting", None, None, None, "FY2022-23", None, None, "0123456789abcdef", 5, "said so", 482e6, "Loan", "Associate"), ("b", "PARTY_TO", "P:1", "Person", "t", "RelatedPartyTxn", "counterparty", None, None, None, "FY2022-23", None, None, "0123456789abcdef", 5, "said so", 482e6, "Loan", "Associate"),
         ("c", "SUBSIDIARY_OF", "C:2", "Company", "C:1", "Company", None, None, None, None, "", 51.0, "2024-03-31", "", 0, "", None, None, None)]
    lab = spark.createDataFrame([("C:1", "Nubora"), ("P:1", "Asha")], "entity_id string, name string")
    out = {r.ref_id: r.text for r in context.fact_texts(spark.createDataFrame(e, cols), lab).collect()}
    assert out == {"a,b": 'Company: Nubora —[RELATED-PARTY TXN FY2022-23: Loan; ₹ 48.20 crore]→ Person: Asha (relationship: Associate)\n  source: doc 0123456789ab…, p.5 | quote: "said so"',
                   "c": "Company: C:2 —[SUBSIDIARY_OF: 51% held; as of 2024-03-31]→ Company: Nubora\n  source: not recorded for this relation"}


def test_leaders_need_a_clear_difference(spark):
    rows = [("a", f"q{i}", "c1", 1.0) for i in range(20)] + [("b", f"q{i}", "c1", float(i >= 15)) for i in range(20)] + [(r, f"r{i}", "c2", 1.0) for r in "ab" for i in range(6)] + [("a", "s1", "c3", 1.0), ("b", "s1", "c3", 0.0)]
    got = {r.category: (r.leader, r.clear) for r in evaluation.leaders(spark.createDataFrame(rows, "run_id string, qid string, category string, correct double")).collect()}
    assert got == {"c1": ("a", True), "c2": (None, False), "c3": ("a", False), "overall": ("a", True)}


def test_cleaned_pages(spark):
    rows = [("d", p, None, f"Nubora  Annual {p}\n\n{w} govern-\nance  of “x” ﬁrm – {p}\n\n\n\nlast {w}\n{p}") for p, w in ((1, "the"), (2, "a"), (3, "one"))] + [("d", 4, None, None)]
    got = {r.page_no: r.text for r in documents.cleaned_pages(spark.createDataFrame(rows, "doc_id string, page_no int, cleaned_text string, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[2] == "a governance of \"x\" firm - 2\n\nlast a\n2"


def test_graph_pieces(spark):
    raw = [("", "HAS_DIRECTOR", "C:1", "Company", "P:1", "Person"), ("", "DIRECTOR_OF", "P:1", "Person", "C:1", "Company"), ("k", "AUDITS", "A:1", "AuditFirm", "C:1", "Company"), ("z", "LIKES", "a", "x", "b", "y"), ("y", "PARTY_TO", "", "x", "b", "y")]
    got = records.forward_edges(spark.createDataFrame(raw, "edge_id string, rel string, src_id string, src_type string, dst_id string, dst_type string")).collect()
    assert {(r.rel, r.src_id, r.dst_id) for r in got} == {("DIRECTOR_OF", "P:1", "C:1"), ("AUDITED_BY", "C:1", "A:1")} and len(got) == 2
    linked = spark.createDataFrame([("Steel", "sector"), ("P:1", "person"), ("P:1", "person"), ("", None)], "entity_id string, kind string")
    comp = spark.createDataFrame([("A", "Steel"), ("B", "Steel"), ("C", "Power")], "company_id string, sector string")
    assert {r.id for r in graph.seeds_of(linked, comp).collect()} == {"C:A", "C:B", "P:1"}


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"qid": "a", "v": 1}\n\n{"qid": "b", "v": 2}\n{"qid": "a", "v": 3}\n')
    assert {(r.qid, r.v) for r in readers.read_results(spark, str(tmp_path / "r.jsonl"), "qid string, v int").collect()} == {("a", 3), ("b", 2)}
    with pytest.raises(FileNotFoundError):
        readers.read_scores(spark, str(tmp_path), "none", "qid string")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "scores.jsonl").write_text('{"qid": "a"}\n')
    assert readers.read_scores(spark, str(tmp_path), "one", "qid string").collect()[0].run_id == "one"
    (tmp_path / "f.pdf").write_bytes(b"%PDF page one|page two")
    assert [(r.page_no, r.text) for r in sorted(readers.read_pdf_pages(spark, str(tmp_path), lambda b: b[5:].decode().split("|")).collect())] == [(1, "page one"), (2, "page two")]
    (tmp_path / "p.json").write_text('{"doc_id": "d", "pages": [], "tables": [{"page_no": 2, "table_idx": 0, "cells": [{"row": 0, "col": 1, "text": "x"}]}]}')
    assert [tuple(r) for r in readers.read_table_cells(spark, str(tmp_path / "p.json")).collect()] == [("d", 2, 0, 0, 1, "x")]
    assert readers.fetch_targets(spark.createDataFrame([("A",)], "company_id string"), ["x", "y"], ["FY1", "FY2"]).count() == 4
    base = spark.createDataFrame([("e1", "R", "a", "b"), ("e2", "R", "a", "c")], "edge_id string, rel string, src_id string, dst_id string")
    new = spark.createDataFrame([("e3", "R", "a", "b")], base.schema)
    assert {r.edge_id for r in writers.merged_edges(base, new).collect()} == {"e1", "e2", "e3"} and {r.edge_id for r in writers.merged_edges(base, new, True).collect()} == {"e3", "e2"}
    s = writers.with_status(spark.createDataFrame([("d", "new"), ("e", "new")], "doc_id string, status string"), spark.createDataFrame([("d", "parsed")], "doc_id string, status string"), "doc_id")
    assert {tuple(r) for r in s.collect()} == {("d", "parsed"), ("e", "new")}
    writers.write_run(str(tmp_path / "run"), {"a": 1}, base)
    writers.write_run(str(tmp_path / "run"), {"a": 2}, base)
    assert (tmp_path / "run" / "config.json").read_text().count("1") == 1 and spark.read.json(str(tmp_path / "run" / "results")).count() == 4
    writers.write_index(spark.createDataFrame([("c", "x y"), ("d", " "), ("e", None)], "chunk_id string, text string"), retrieval.hashed_embedding(4), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 1


def test_relations_choose_hops(spark):
    df = spark.createDataFrame([("Who audited it?",), ("Tell me all",), ("Promoters and directors",)], "q string")
    first, second = text.choose_relations(text.relations_asked(F.col("q")))
    got = [(r.a, r.b) for r in df.select(first.alias("a"), second.alias("b")).collect()]
    assert got[0] == (["AUDITED_BY"], ["AUDITED_BY"]) and len(got[1][0]) == 7 and "AUDITED_BY" not in got[1][1] and got[2][0] == ["DIRECTOR_OF", "HOLDS_STAKE"]

"""Groups, survivors, mixture and names against brute force."""

import itertools
import json
import random
from collections import defaultdict
from datetime import datetime

import pytest

from ledgermill.llm import components, mixture, names, survivors


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def grouped(df):
    g = defaultdict(set)
    for r in df.collect():
        g[r.root].add(r.id)
    return {frozenset(x) for x in g.values()}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "cycle"])
def test_components_equal_union_find(spark, shape, monkeypatch):
    rnd = random.Random(5)
    if shape == "random":
        pairs = [(f"m{rnd.randint(0, 400):03d}", f"m{rnd.randint(0, 400):03d}") for _ in range(260)]
    elif shape == "chain":
        pairs = [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(60)]
    elif shape == "star":
        monkeypatch.setattr(components, "MAX_DEGREE", 20)
        monkeypatch.setattr(components, "HUB_PARTS", 1000)
        pairs = [("hub", f"m{i:03d}") for i in range(150)] + [("m000", "x")]
    else:
        pairs = [(f"m{i:03d}", f"m{(i + 1) % 9:03d}") for i in range(9)]
    rows = pairs + pairs[:20] + [("m000", "m000"), (None, "m001"), ("m002", None)]
    df = spark.createDataFrame(rows, "src string, dst string")
    want = union_find([(a, b) for a, b in pairs if a != b])
    assert grouped(components.connected_groups(df)) == want


def test_components_of_an_empty_table(spark):
    assert components.connected_groups(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_mention_groups_rules(spark):
    m = [("a:p", "person", "A", "asha rao", {"din": "00000001"}, "C1", "r"), ("b:p", "person", "B", "a rao", {"din": "00000001"}, "C2", "r"), ("c:p", "person", "C", "asha rao", None, "C1", "r"),
         ("d:p", "person", "D", "x", {"din": "00000000"}, None, "r"), ("e:p", "person", "E", "y", {"din": "00000000"}, "C3", "r"), ("f:c", "company", "F", "firm", {"company_id": "Z"}, "C1", "r"),
         ("g:c", "company", "G", "", {}, "C1", "r"), ("h:c", "company", "H", "", {}, "C1", "r"), ("i:p", "person", "I", None, {}, "C9", "r")]
    mentions = spark.createDataFrame(m + m[:2], "mention_id string, kind string, raw_name string, norm_name string, ids map<string,string>, context_company_id string, record_id string").withColumnRenamed("raw_name", "root")
    pairs = spark.createDataFrame(
        [(1, "e:p", "d:p", "fuzzy", None), (2, "d:p", "e:p", "fuzzy", 9.0), (3, "a:p", "d:p", "review_queue", 99.0), (4, "a:p", "gone", "fuzzy", 1.0), (5, "gone", "i:p", "fuzzy", 1.0), (6, "f:c", "i:p", "exact_name", 1.0), (7, "i:p", "i:p", "fuzzy", 1.0)],
        "pair_id bigint, mention_a string, mention_b string, method string, score double")
    got = {tuple(r) for r in components.mention_groups(mentions, pairs).collect()}
    assert got == {("a:p", "a:p"), ("b:p", "a:p"), ("c:p", "a:p"), ("d:p", "d:p"), ("e:p", "d:p")}


def brute_best(bundles):
    best = None
    for combo in itertools.product(*bundles):
        fixed, ok = {}, True
        for c in combo:
            for k, v in c["fixed"].items():
                if v is not None and fixed.setdefault(k, v) != v:
                    ok = False
        if ok and (best is None or sum(c["trust"] for c in combo) > best):
            best = sum(c["trust"] for c in combo)
    return best


def test_branch_and_bound_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        bundles = [[{"trust": rnd.randint(-5, 20), "fixed": {k: rnd.choice(["a", "b", None]) for k in rnd.sample("xyz", 2)}} for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 4))]
        got = survivors.best_combination(bundles)
        assert (None if got is None else sum(c["trust"] for c in got)) == brute_best(bundles)
    assert survivors.best_combination([[], [{"trust": 1, "fixed": {}}]]) is None


def test_survivors(spark):
    at = datetime(2024, 1, 1)
    day = lambda n: at.replace(day=n)
    rows = [
        (1, "P:1", "person", "Asha Kumar Raosvi", " Asha  Raosvi|N/A||ASHA RAOSVI", "filing", day(1)), (2, "P:1", "person", "ASHA KUMAR RAOSVI", None, "ocr", day(2)), (3, "P:1", "person", "Asha Ku", "-", "registry", day(3)),
        (4, "P:1", "person", "A. Raosvi", "", "ocr", day(4)), (5, "P:1", "person", "Asha Kumar Ra0svi", None, "ocr", day(5)), (6, "P:1", "person", "see above", None, "ocr", day(6)), (7, "P:1", "person", None, None, None, None),
        (8, "C:1", "company", "Firm Steel Limited", "Firm Steel", "manual", day(1)), (9, "C:1", "company", "Firm Steel Ltd", None, "manual", day(2)), (10, "C:1", "company", "Firm St", None, "ocr", day(3)),
        (11, "C:2", "company", "Alone Limited", "Alone", "manual", day(1)), (11, "C:2", "company", "Alone Limited", "Alone", "manual", day(1)), (12, None, "person", "No Id", None, "ocr", day(1))]
    df = spark.createDataFrame(rows, "row_id bigint, entity_id string, kind string, canonical_name string, aliases_text string, source string, updated_at timestamp")
    got = {tuple(r) for r in survivors.survivor_fields(df.selectExpr("*", "1 as trust", "2 as f")).collect()}
    assert got == {("P:1", "canonical_name", "Asha Kumar Raosvi"), ("P:1", "aliases_text", "Asha Raosvi"), ("P:1", "aliases_text", "ASHA RAOSVI"), ("C:1", "canonical_name", "Firm Steel Limited"), ("C:1", "aliases_text", "Firm Steel")}
    assert survivors.surviving_entities(df.limit(0)).count() == 0


def test_pivot_keeps_tokens_and_settles_one():
    rnd = random.Random(4)
    for i in range(200):
        a = {"doc_id": i, "n_tokens": rnd.randint(1, 900), "p": rnd.uniform(0.01, 0.99)}
        b = {"doc_id": i + 1000, "n_tokens": rnd.randint(1, 900), "p": rnd.uniform(0.01, 0.99)}
        before = a["p"] * a["n_tokens"] + b["p"] * b["n_tokens"]
        done, open_ = mixture.pivot(a, b, i)
        assert done["p"] in (0.0, 1.0) and 0 <= open_["p"] <= 1
        assert abs(before - done["p"] * done["n_tokens"] - open_["p"] * open_["n_tokens"]) < 1e-4


def test_mixture_reaches_shares_within_caps(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["word"] * rnd.randint(5, 120)), "Big Source") for i in range(900)] + [(1000 + i, " ".join(["note"] * 40), "small") for i in range(60)] + [(5000, "x " * 4000, "small")]
    rows += [(6000, None, "small"), (6001, "", "small"), (6002, "text", None), (6003, "text", "other"), (0, rows[0][1], "BIG-SOURCE")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as copies", "2 as p")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    copies, plan = mixture.mix(docs, targets)
    rep = {r.source: r for r in mixture.reached_shares(copies, plan).collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert rep["absent"].actual_share == 0 and all(r.most_copies <= r.max_repeats for r in rep.values())
    assert abs(rep["big_source"].actual_share - 5 / 9) < 0.02 and abs(rep["small"].actual_share - 4 / 9) < 0.02
    assert copies.groupBy("doc_id").count().where("count > 1").count() == 0
    again = {(r.doc_id, r.copies) for r in mixture.mix(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in copies.collect()}
    assert mixture.mix(docs.limit(0), targets)[0].count() == 0


def test_slips():
    assert names.one_slip("gautam", "gatuam") and names.one_slip("wasim", "wsim") and names.one_slip("rohit", "rohat") and not names.one_slip("rohit", "mohat") and not names.one_slip("a", "a")
    for a, b in [("gautam", "gatuam"), ("wasim", "wsim"), ("rohit", "rohat")]:
        assert set(names.deletions(a)) & set(names.deletions(b))


def _record(i, kind, **payload):
    return (f"r{i}", kind, json.dumps(payload), "accepted")


def test_names_of_one_entity_are_linked(spark):
    rows = []
    people = ["Irfan Bhaskar Kuledruri", "Irfan Bhaskar Kuledruri", "Kuledruri, Irfan Bhaskar", "Smt. Irfan Bhaskar Kuledruri", "IRFAN KULEDRURI", "Irfna Bhaskar Kuledruri", "I B Kuledruri", "Irfan B. Kuledruri"]
    others = ["Usha Kuledruri", "Asha Kuledruri", "Ganesh Mohan Kuledruri", "Tarun Velaris", "Usha Velaris", "Asha Velaris"]
    firms = ["Destrinom Motors Limited"] * 3 + ["Destrinom Motors Ltd.", "M/s Destrinom Motors Limited", "Des trinom Motors Limited", "DestrinomMotors Limted", "Destrinom Mootrs Limited", "Destrinom Motors Limited (formerly known as Old Motors Limited)"]
    sister = ["Destrinom Foods Limited", "Destrinom Motors Finance Limited"]
    for i, (p, c) in enumerate(itertools.zip_longest(people + others, firms + sister)):
        rows.append(_record(i, "directors", person_name=p, company_name=c, din=None))
    rows += [_record(90, "rpt", counterparty_name="Destrinom Motors"), _record(91, "shareholding", holder_name="  ", holder_kind="person"), ("r92", "rpt", "not json", "review"), ("r93", "directors", None, None)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, payload_json string, status string")
    root = {r.name: r.root for r in names.name_groups(df).collect()}
    same = lambda xs: {root.get(x, x) for x in xs}
    assert len(same(people)) == 1 and len(same(firms + ["Destrinom Motors"])) == 1
    assert len(same(others + sister + people[:1] + firms[:1])) == len(others) + len(sister) + 2
    pairs = names.same_pairs(names.name_groups(df)).collect()
    assert all(r.name_a < r.name_b for r in pairs) and len(pairs) == len(set(pairs))
    assert names.name_groups(df.limit(0)).count() == 0


def test_a_slip_that_many_strings_repeat_is_undone(spark):
    surnames = ["Kuledruri", "Velaris", "Oskandra", "Tumbrokar", "Halontol", "Fenayvun", "Moridam", "Pinalkup"]
    rows = [_record(i, "directors", person_name=f"{given} {s}", company_name="Destrinom Motors Limited")
            for i, (given, s) in enumerate([("Gautam", x) for x in surnames for _ in range(6)] + [("Gautam", f"{x}{y}") for x in surnames for y in ("war", "kar", "nath")] + [("Gatuam", x) for x in surnames[:4]])]
    # a run-together slip in three spellings, of a name no other word repeats
    firms = ["Gallimorn Ports Limited", "GALLIMORN PORTS LIMITED", "Gallimorn Ports Ltd"]
    wrong = ["GALLIMORNPOTRS LIMITED", "Gallimorn Potrs Ltd", "Gallimornpotrs Ltd"]
    rows += [_record(200 + i, "directors", person_name="Usha Rao", company_name=c) for i, c in enumerate(firms * 10 + wrong)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, payload_json string, status string")
    root = {r.name: r.root for r in names.name_groups(df).collect()}
    for x in surnames[:4]:
        assert root[f"Gatuam {x}"] == root[f"Gautam {x}"]
    assert len({root[x] for x in firms + wrong}) == 1


def test_cut_words_are_expanded_by_ratio():
    from ledgermill.llm.names import RIGHT, company_forms

    word = lambda t, df: {"t": t, "form": names.FULL, "legal": False, "df": df}
    assert company_forms([word("velaris", 9), word("manuf", 40)], {"manufacturing": 40 * RIGHT})["words"] == "manufacturing velaris"
    assert company_forms([word("velaris", 9), word("manuf", 40)], {"manufacturing": 40 * RIGHT - 1})["words"] == "manuf velaris"


def test_any_string_may_be_an_id(spark):
    odd = ["a\x1f1", "\x01p", "s0:v", "v", "m", "", " "]
    rows = [(odd[i], odd[i + 1]) for i in range(0, 6)] + [("x", "y")]
    got = grouped(components.connected_groups(spark.createDataFrame(rows, "src string, dst string")))
    assert got == {frozenset(odd), frozenset(["x", "y"])}


def test_pairs_of_a_large_group_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(names, "PART", 7)
    rows = [(f"n{i:02d}", "big") for i in range(40)] + [("a", "s"), ("b", "s"), ("c", "alone")]
    got = {tuple(r) for r in names.same_pairs(spark.createDataFrame(rows + rows[:5], "name string, root string")).collect()}
    assert got == {(f"n{i:02d}", f"n{j:02d}") for i in range(40) for j in range(i + 1, 40)} | {("a", "b")}


def test_beginnings_of_longer_names_are_cut_off(spark):
    rows = [(1, "P:1", "person", "Asha Rao", None, "filing", datetime(2024, 3, 1)), (2, "P:1", "person", "Asha Raokar Singh", None, "ocr", datetime(2024, 1, 1)), (3, "P:1", "person", "Asha Ravi", None, "ocr", datetime(2024, 2, 1)),
            (4, "P:2", "person", "Asha Rao", None, "filing", datetime(2024, 3, 1)), (5, "P:2", "person", None, "x|y| x", "manual", datetime(2024, 4, 1))]
    df = spark.createDataFrame(rows, "row_id bigint, entity_id string, kind string, canonical_name string, aliases_text string, source string, updated_at timestamp")
    got = {tuple(r) for r in survivors.survivor_fields(df).collect()}
    assert got == {("P:1", "canonical_name", "Asha Ravi"), ("P:2", "canonical_name", "Asha Rao"), ("P:2", "aliases_text", "x"), ("P:2", "aliases_text", "y")}
    one = {r.entity_id: r for r in survivors.with_aliases(survivors.surviving_entities(df), df).collect()}
    assert one["P:2"].aliases == ["x", "y"] and one["P:2"].source == "manual" and one["P:1"].aliases == []

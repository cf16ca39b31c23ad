"""Tokenizer, splitter, personal data and page repair."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermill.llm import pages, pii, splitter, tokenizers


def test_long_text_is_encoded_as_a_whole_text_is():
    path = tokenizers.vocabulary_path()
    rnd = random.Random(1)
    words = ["naïve", "don't", "  two", "\n\nline", "₹1,234.50", "कंपनी", "<|endoftext|>", "x" * 300, "\t tab", "—", "2023-24"]
    text = " ".join(rnd.choice(words) for _ in range(9000))
    assert len(text) > 2 * tokenizers.LONG_TEXT
    assert len(tokenizers.segments(text)) > 2 and "".join(tokenizers.segments(text)) == text
    assert tokenizers.encode_text(text, path) == tokenizers.encoder(path).encode_ordinary(text)
    no_gap = "ab" * 30_000
    assert tokenizers.segments(no_gap) == [no_gap]


def test_encoding_round_trip_and_defined_ids_for_empty_and_null(spark):
    texts = [None, "", "plain <|endoftext|> text", "emoji 🙏 ok", "कंपनी", " \n "]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    rows = {r.doc_id: r.ids for r in tokenizers.encode_table(df).collect()}
    assert rows[0] == [] and rows[1] == [] and 50256 not in rows[2]
    back = {r.doc_id: bytes(r.b).decode() for r in tokenizers.encode_table(df).select("doc_id", tokenizers.decode(F.col("ids")).alias("b")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokenizers.encode_table(df.limit(0)).count() == 0


def test_ids_equal_the_other_librarys(spark, data):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokenizers.DEFAULT_DIR}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in tokenizers.encode_table(docs).collect():
        assert r.ids == (tok.encode(text[r.doc_id], add_special_tokens=False).ids if text[r.doc_id] else [])


def test_pieces_cover_the_text_under_the_limit_with_bounded_overlap():
    rnd = random.Random(3)
    for kind in range(6):
        sep = ["\n\n", "\n", ". ", " ", "", "\r\n"][kind]
        text = sep.join("w" * rnd.randint(1, 30) for _ in range(rnd.randint(200, 1500)))
        got = splitter.spans(text)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(splitter.estimate(b - a) <= 800 for a, b in got)
        for (a, b), (c, e) in zip(got, got[1:]):
            assert a < c <= b < e and b - c <= 240
    assert splitter.spans("a" * 3203) == [(0, 3203)] and len(splitter.spans("a" * 3204)) == 2


def test_cuts_fall_on_paragraphs_first():
    para = "word " * 300
    text = "\n\n".join([para.strip()] * 5)
    first = splitter.spans(text)[0]
    assert text[: first[1]].endswith("\n\n")


def test_split_table_edge_cases(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "x" * 5000, None), ("c", "x" * 5000, None), ("d", "short", 3)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, page_start int").withColumn("piece_no", F.lit("clash"))
    out = splitter.split_table(df).collect()
    n = {k: sum(r.chunk_id == k for r in out) for k in "abcd"}
    assert n == {"a": 1, "b": 1, "c": 4, "d": 1}
    assert all(r.piece == "" and r.piece_tokens == 0 for r in out if r.chunk_id in "ab")
    assert splitter.split_table(df.limit(0)).count() == 0


def found(text):
    return {(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)}


def test_personal_data_kinds():
    t = ("Write to <asha.rao+agm@post.example> or nikhil_18 [at] mail [dot] test. Tel: +91 55716 88037 (ext. 12). KYC on file (PAN: ABCPD1234E). "
         "Aadhaar 5545-6000-4582 was seen; masked XXXX XXXX 5846. DIN 00224973 and DIN: 00312121. GSTIN 27ABCPE0276P1Z5. Order no. ADJ/RS/209912/2023.\n"
         "Address: Flat 14A, Sagar Kunj, Marigold Road, Velapuri 514 944, as per the register. The notice was served at 76, Neem Marg, Moharpur.\n"
         "As Smt. V. Nimukri noted, all is well. Rao, Mehta & Associates were present. The Board thanked ganesh kumar for the services rendered.\n"
         "By order of the Board\nI. M. Lonure\nCompany Secretary")
    got = found(t)
    assert {("email", "asha.rao+agm@post.example"), ("email", "nikhil_18 [at] mail [dot] test"), ("phone", "+91 55716 88037"), ("id_number", "ABCPD1234E"),
            ("id_number", "5545-6000-4582"), ("id_number", "00224973"), ("id_number", "00312121"), ("address", "Flat 14A, Sagar Kunj, Marigold Road, Velapuri 514 944"),
            ("address", "76, Neem Marg, Moharpur"), ("name", "V. Nimukri"), ("name", "ganesh kumar"), ("name", "I. M. Lonure")} == got


def test_checksums():
    assert pii.luhn("4111 1111 1111 1111") and not pii.luhn("4111 1111 1111 1112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Mail a@b.example now"), (2, None), (3, ""), (4, "no data " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.t for r in df.select("doc_id", pii.redact(F.col("text")).alias("t")).collect()}
    assert out[1] == "Mail [EMAIL] now" and out[2] is None and out[3] == "" and out[4] == rows[3][1]
    assert [tuple(r) for r in pii.found_items(df.unionByName(df)).collect()] == [(1, "email", "a@b.example")]
    assert pii.found_items(df.limit(0)).count() == 0


BODY = [
    "The committee reviewed the quarterly position of the plant and", "approved the remuneration of the auditors within the agreed peri-",
    "od. The company has not defaulted in repayment of any borrowings", "and no further dividends are expected before the annual meeting.",
    "The cornmittee reviewed the cost-effective repayment of dividends", "within the agreed period and the quarterly position of the plant.",
]


def _pages(spark, repeat=1):
    rows = []
    for doc in ("d1", "d2", "d3"):
        for p in range(11, 17):
            body = BODY if p % 2 else [x.replace("cornmittee", "committee") for x in BODY]
            rows.append((doc, p, None, "\n".join(["Annual Report 2022-23", "", *body, f"Page {p} of 90"]), False))
    rows += [("d1", 99, None, None, True), ("d2", 98, "  \n ", None, True), (None, 1, "x", "x", False)]
    return spark.createDataFrame(rows * repeat, "doc_id string, page_no int, cleaned_text string, text string, is_probable_scan boolean")


def test_page_noise(spark):
    got = {tuple(r) for r in pages.found_noise(_pages(spark, 2)).collect()}
    for doc in ("d1", "d2", "d3"):
        for p in range(11, 17):
            assert {(doc, p, 1, "furniture"), (doc, p, 9, "furniture"), (doc, p, 4, "hyphen")} <= got
            assert ((doc, p, 7, "ocr") in got) == bool(p % 2)
    assert len(got) == 3 * (6 * 3 + 3)


def test_paragraphs_are_repaired_and_run_on(spark):
    rows = pages.paragraphs(_pages(spark)).where("doc_id = 'd1'").orderBy("para_no").collect()
    text = " ".join(r.text for r in rows)
    assert "agreed period. The company" in text and "cornmittee" not in text and "Annual Report" not in text and "cost-effective" in text
    assert [r.para_no for r in rows] == list(range(len(rows)))


def test_pages_of_an_empty_table(spark):
    assert pages.found_noise(_pages(spark).limit(0)).count() == 0


def test_small_page_functions():
    assert pages.roman("cxix") == 119 and pages.roman("xli") == 41
    assert pages.page_number("- 12 -") == (12, True) and pages.page_number("l2") == (12, False) and pages.page_number("12.5") == (None, False)
    assert pages.numeric_misread("33.O") and pages.numeric_misread("2O19-20") and not pages.numeric_misread("FY2021-22")


def test_check_digits_and_words_after_a_number():
    def found(text):
        return [(x.kind, text[x.start : x.end]) for x in pii.find_spans(text)]

    good = next(f"2345 6789 012{d}" for d in range(10) if pii.verhoeff(f"23456789012{d}"))
    bad = next(f"2345 6789 012{d}" for d in range(10) if not pii.verhoeff(f"23456789012{d}"))
    assert found(f"He gave {good} there") == [("id_number", good)] and found(f"He gave {bad} there") == []
    assert found("Paid by 4111 1111 1111 1111 then") == [("id_number", "4111 1111 1111 1111")] and found("Paid by 4111 1111 1111 1112 then") == []
    assert found("Wire to GB82 WEST 1234 5698 7654 32 now") == [("id_number", "GB82 WEST 1234 5698 7654 32")] and found("Wire to GB83 WEST 1234 5698 7654 32 now") == []
    assert found("5928728864 (mobile)") == [("phone", "5928728864")] and found("00312121 (DIN)") == [("id_number", "00312121")]
    assert found("in 00312120 shares, DIN 00312121") == [("id_number", "00312121")]
    year = next(f"{a} {a + 1} {a + 2}" for a in range(2000, 2098) if pii.verhoeff(f"{a}{a + 1}{a + 2}"))
    assert found(f"in {year} it") == []


def test_names_by_general_evidence(spark):
    def names(text, given=frozenset()):
        return {text[x.start : x.end] for x in pii.find_spans(text, given) if x.kind == "name"}

    text = "We met Ravi Kumar yesterday. Payment was made by Asha Mehta to the vendor. Ravi Kumar Associates and Asha Steel Limited were paid; asha mehta agreed."
    assert names(text, {"ravi", "asha"}) == {"Ravi Kumar", "Asha Mehta"} and names(text) == set()
    assert names("The claim of R. K. Narayanan's estate was settled.") == {"R. K. Narayanan"}
    assert names("Mrs. Lila de Souza spoke, and Sen, Amartya said no.", {"amartya"}) >= {"Sen, Amartya"}
    assert names("A cheque went to usha iyer in May.", {"usha"}) == set()
    assert names("It was thanked usha iyer there.", {"usha"}) == {"usha iyer"}
    assert names("He lives at 12, Ravi Kumar Marg, Velapuri 514 944.", {"ravi"}) == set()
    rows = [(1, "Dr. Tara Sen came. Mr. Bose left.\nYours faithfully,\nKiran Rao"), (2, None), (3, ""), (4, "Shri Board Member spoke")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.given_names(df, "text") == {"tara", "kiran"}
    assert pii.given_names(df.limit(0), "text") == frozenset()
    assert {r.found_value for r in pii.found_items(df.unionByName(spark.createDataFrame([(5, "Then Tara Bose sat.")], df.schema))).collect() if r.kind == "name"} >= {"Tara Bose", "Tara Sen", "Kiran Rao"}


def test_many_spans_are_taken_apart_without_loss():
    text = "; ".join(f"user{i}@mail{i}.example" for i in range(5000))
    assert len(pii.find_spans(text)) == 5000


def test_pattern_of_a_page_is_that_of_its_lines():
    text = "Annual Report 2022-23 | Some Firm\n\n  12      Notes to accounts\nSOME FIRM LIMITED\nThe cornmittee paid 1O lakh\nx\n_a_ (b) c, d e\n"
    lines = pages.page_lines(text)
    assert pages.skeletons(text, lines) == [pages.skeleton(x) for x in lines]
    assert pages.page_number("xiv") == (14, True) and pages.page_number("mild") == (None, False) and pages.page_number("12 | " + "long " * 40)[0] == 12


def test_damaged_headers_far_numbers_and_far_breaks(spark):
    rows = []
    for p in range(1, 13):
        head = "Yearly Statement of the Nubora Works" if p != 6 else "Yearly Statement of the Nubra Works"
        body = "\n".join(f"the plant number {p} was seen by a {w} visitor and the committee said so" for w in ("first", "second", "third", "fourth", "fifth"))
        rows.append(("d1", p, f"{head}\n{body}\n{p + 180}"))
    rows += [("d2", 1, "the committee approved the remu-")] + [("d2", p, "\n\n") for p in range(2, 8)] + [("d2", 8, "neration of the auditors in full"), ("d2", 9, "the remuneration was paid")]
    df = spark.createDataFrame([(d, p, None, t, False) for d, p, t in rows], "doc_id string, page_no int, cleaned_text string, text string, is_probable_scan boolean")
    got = {tuple(r) for r in pages.found_noise(df).collect()}
    assert {("d1", p, 1, "furniture") for p in range(1, 13)} | {("d1", p, 7, "furniture") for p in range(1, 13)} <= got
    assert not any(k == "furniture" and d == "d1" and n not in (1, 7) for d, p, n, k in got)
    assert ("d2", 1, 1, "hyphen") in got

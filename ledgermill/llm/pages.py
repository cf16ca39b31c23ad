"""Repair of text from scanned pages: furniture, broken words and misread characters."""

from __future__ import annotations

import re as sre
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgermill.functions.fuzzy import indel_ratio
from ledgermill.llm.ocr import fold, fold_text
from ledgermill.operators.skew import skew_join_unique
from ledgermill.session import cut_lineage

#: Non-blank lines counted as the edge of a page, at the top and at the bottom.
EDGE = 4
#: Share of a line pattern's occurrences in the corpus that lie at page edges, from which it is no body line.
EDGE_SHARE, EDGE_SHARE_ALONE, ALONE = 0.6, 0.85, 5
#: Share of a short line's occurrences that interrupt a paragraph, from which it is a stamp, and how often it must occur.
STAMP_SHARE, STAMP_TIMES = 0.3, 4
#: A word is frequent from this share of all words on, so there are at most FREQUENT such words to send to every task.
FREQUENT = 50_000
#: A spelling is misread when another of equal fold occurs this many times as often.
OUTNUMBERS = 3
#: A bare number farther than FAR from page_no is a page number when FAR_PAGES pages or more have that distance, not two.
FAR, FAR_PAGES = 60, 3
#: Both halves of a broken word that was never seen whole are words of their own from this share of all words on.
HALF_SHARE = 1e-6
#: Similarity of an edge line's pattern to a repeated one, from which a damaged repetition counts as one.
ALIKE = 90.0
HYPHENS = "-\u2010\u00ac\u00ad"
_SOFT = "\u00ac\u00ad"

_DIGITLIKE = sre.compile(r"(?<![^\W_])[0-9OolISB|!]*[0-9][0-9OolISB|!]*(?![^\W\d_])")
#: Letters and digits that touch within what may be a number.
_MIXED = sre.compile(r"[0-9A-Za-z|!.,/-]*(?:[0-9][.,]?[OolISB|!]|[OolISB|!][.,]?[0-9])[0-9A-Za-z|!.,/-]*")
_FOUR_LETTERS = sre.compile(r"(?:[^\W\d_].*?){4}")
_SEPARATORS = sre.compile(r"[\W\d_]+")
#: A letter no page has, in place of line ends while all lines of a page are rewritten.
_LINE_END = "\ua66e"
#: A page number set off from a header or footer on the same line.
_SET_OFF = sre.compile(r"^\s*[0-9OolISB]{1,5}\s{3,}(?=\S)|(?<=\S)\s{3,}[0-9OolISB]{1,5}\s*$")
_CAPS_FIRM = re.compile(r"[\p{Lu}0-9!|á ]+ (?:L[I1l!]M[I1l!]TED|LLP|C[O0]RP[O0]RAT[I1l!][O0]N)")
_TO_DIGIT = str.maketrans("OolISB|!", "00115811")
_LETTERS = sre.compile(r"[^\W\d_]")
_ROMAN = re.compile(r"(?=.)m*(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})", re.I)
_DIGIT = sre.compile(r"[0-9]")
_NUMBER_FORMS = [
    # pattern of a whole line with the number as group n; strong forms are page numbers by their shape
    (re.compile(r"[-–—]\s*(?P<n>[0-9OolISB]{1,5})\s*[-–—]"), True), (re.compile(r"\[\s*(?P<n>[0-9OolISB]{1,5})\s*\]"), True),
    (re.compile(r"p(?:age|\.)\s*(?P<n>[0-9OolISB]{1,5})(?:\s*(?:of|/)\s*[0-9OolISB]{1,5})?", re.I), True),
    (re.compile(r"(?P<n>[0-9OolISB]{1,5})\s*\|\s*\D.*"), True), (re.compile(r".*\D\s*\|\s*(?P<n>[0-9OolISB]{1,5})"), True),
    (re.compile(r"(?P<n>[0-9OolISB]{1,5})"), False),
]
_BAR_INSIDE = sre.compile(r"[^\W\d_][!|][^\W\d_]")
_TWO_LETTERS = sre.compile(r"[^\W\d_].*?[^\W\d_]")
#: A word with the odd characters that misreading puts into it.
_TOKEN = sre.compile(r"[\w!|]+(?:['’][^\W\d_]+)?")


def roman(s: str) -> int | None:
    """Value of a roman numeral; None if it is none."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [values.get(c) for c in s.lower()]
    if not n or None in n:
        return None
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def is_roman(s: str) -> bool:
    """True for a numeral in its one right spelling, so that few words pass."""
    return bool(_ROMAN.fullmatch(s))


def skeleton(line: str) -> str | None:
    """What a line has in common with its repetitions: fold, numbers as #, single spaces. None without four letters.

    A number set off at either end is left out, of parts between bars only those with a number count, and a company's
    name in capitals alone stands for any such name, so that headers of all documents share a pattern.
    """
    if not _FOUR_LETTERS.search(line):
        return None
    s = _SET_OFF.sub("", line).strip() if "   " in line else line.strip()
    if s.isupper() and _CAPS_FIRM.fullmatch(s):
        return "@"
    parts = [_DIGITLIKE.sub(" zz ", x) for x in s.split(" | ")]
    if len(parts) > 1:
        parts = [x if " zz " in x else "@" for x in parts]
    return "|".join(_SEPARATORS.sub(" ", fold_text(x)).strip() for x in parts)


def skeletons(text: str, lines: list[str]) -> list[str | None]:
    """skeleton of each line of a text; the plain lines are rewritten all at once, which costs a third."""
    at_once = _SEPARATORS.sub(" ", fold_text(_DIGITLIKE.sub(" zz ", text)).replace("\n", _LINE_END)).split(_LINE_END)
    plain = len(at_once) == len(lines)
    out: list[str | None] = []
    for line, folded in zip(lines, at_once if plain else lines):
        if not plain or "|" in line or "   " in line or (line.isupper() and _CAPS_FIRM.fullmatch(line.strip())):
            out.append(skeleton(line))
        else:
            out.append(folded.strip() if _FOUR_LETTERS.search(line) else None)
    return out


def page_number(line: str) -> tuple[int | None, bool]:
    """(number, strong) if the whole line may be a page number, else (None, False)."""
    s = line.strip()
    if _DIGIT.search(s):
        for pattern, strong in _NUMBER_FORMS:
            m = pattern.fullmatch(s)
            if m and _DIGIT.search(m["n"]):
                return int(m["n"].translate(_TO_DIGIT)), strong
    elif (s.islower() or s.isupper()) and " " not in s and is_roman(s):
        return roman(s), True
    return None, False


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def page_lines(text: str) -> list[str]:
    return text.split("\n")


def _width(lengths: list[int]) -> float:
    """The 80th percentile, interpolated."""
    x = sorted(lengths)
    k = 0.8 * (len(x) - 1)
    i = int(k)
    return x[i] + (k - i) * (x[min(i + 1, len(x) - 1)] - x[i])


def line_features(text: str) -> list[tuple]:
    """(line_no, pattern hash, at edge, interrupts, page number, strong number, pattern) of the lines that may be furniture
    or count against it; the pattern itself only at an edge."""
    lines = page_lines(text)
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return []
    width = _width([len(lines[i]) for i in full])
    patterns = skeletons(text, lines)
    out = []
    for k, i in enumerate(full):
        line = lines[i]
        edge = k < EDGE or k >= len(full) - EDGE
        num, strong = page_number(line) if edge else (None, False)
        s = patterns[i]
        if s is None and num is None:
            continue
        bare, before = line.strip(), lines[i - 1].rstrip() if i else ""
        runner = False
        if edge and not line.lstrip()[:1].islower() and bare[-1:] not in ".,;":
            words = bare.split()
            runner = len(bare) <= 0.8 * width or sum(not w[0].islower() for w in words) >= 0.4 * len(words)
        torn = len(bare) < 0.7 * width < len(before) and before[-1] not in ".:!?;" and bare[-1:] not in ".,;:" and 0 < i < len(lines) - 1
        out.append((i + 1, _hash(s) if s is not None else None, runner, torn, num, strong, s if runner else None))
    return out


_FIELDS = {"line_no": "int", "h": "bigint", "edge": "boolean", "torn": "boolean", "num": "int", "strong": "boolean", "pattern": "string"}
_FEATURES = "struct<" + ",".join(f"{k}:array<{t}>" for k, t in _FIELDS.items()) + ">"


def page_table(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, txt): one row a page, text or else cleaned_text; of repeated pages the longest, then greatest, text."""
    t = F.coalesce("text", "cleaned_text")
    p = pages.where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & t.isNotNull()).select("doc_id", "page_no", t.alias("txt"))
    return p.groupBy("doc_id", "page_no").agg(F.max_by("txt", F.struct(F.length("txt"), "txt")).alias("txt"))


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no) of running headers and footers, page numbers and stamps of a page_table.

    Header or footer: a pattern at the edges of two or more pages of the document which in the whole corpus lies mostly
    at edges, or one that the corpus shows almost only at edges; then every line of that pattern in the document, and
    every edge line of the document whose pattern is ALIKE to it, so that a lost or strange character does not end a
    repetition. Page number: a line at an edge that has a page number's form, or a bare number, and whose distance to
    page_no is 0 or that of another page of the document; a bare number over FAR away needs FAR_PAGES such pages.
    Stamp: a short line that in the corpus often interrupts a paragraph. Lines of a document are told apart by a pair of
    64-bit hashes, patterns of the corpus by one, where a collision only blurs a count.
    """
    @F.pandas_udf(_FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [list(zip(*line_features(t))) or [()] * len(_FIELDS) for t in s]
            yield pd.DataFrame({k: [list(r[i]) for r in rows] for i, k in enumerate(_FIELDS)})

    zipped = F.explode(F.arrays_zip(*[F.col(f"x.{k}").alias(k) for k in _FIELDS]))
    lines = pages.select("doc_id", "page_no", features("txt").alias("x")).select("doc_id", "page_no", zipped.alias("l")).select("doc_id", "page_no", "l.*")
    lines = cut_lineage(lines.withColumn("d", F.xxhash64("doc_id")))
    per_doc = lines.where("h is not null").groupBy("h", "d").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("pages"), F.count_if("torn").alias("t"), F.max("pattern").alias("pattern"))
    per_doc = cut_lineage(per_doc)
    corpus = per_doc.groupBy("h").agg(F.sum("n").alias("cn"), F.sum("pages").alias("ce"), F.sum("t").alias("ct"), F.max("pages").alias("most"))
    of_document = f"ce >= {EDGE_SHARE} * cn"
    anywhere = f"(cn >= {ALONE} and ce >= {EDGE_SHARE_ALONE} * cn) or (cn >= {STAMP_TIMES} and ct >= {STAMP_SHARE} * cn)"
    corpus = corpus.where(f"(most >= 2 and {of_document}) or {anywhere}").drop("most")
    # a pattern such as "page #" has a row a document, so its key is split
    repeated = cut_lineage(skew_join_unique(per_doc, corpus, "h").where(f"(pages >= 2 and {of_document}) or {anywhere}").select("h", "d", "pages", "pattern"))
    runners = lines.where("h is not null").join(repeated.select("h", "d"), ["h", "d"], "left_semi").select("doc_id", "page_no", "line_no")
    nums = lines.where("num is not null").withColumn("off", F.col("num") - F.col("page_no"))
    steady = nums.groupBy("doc_id", "off").agg(F.count_distinct("page_no").alias("k")).where("k >= 2 or off = 0")
    numbers = nums.join(steady, ["doc_id", "off"]).where(f"strong or abs(off) <= {FAR} or k >= {FAR_PAGES}").select("doc_id", "page_no", "line_no")
    return runners.unionByName(numbers).unionByName(_damaged_runners(lines, per_doc, repeated)).distinct()


def _damaged_runners(lines: DataFrame, per_doc: DataFrame, repeated: DataFrame) -> DataFrame:
    """Edge lines of unrepeated patterns that are ALIKE to a pattern repeated at the edges of the same document's pages.

    Patterns meet by equi-join on the document and either half of their words, as one damage leaves a half whole.
    """
    def halves(df: DataFrame) -> DataFrame:
        w = F.split("pattern", "[ |]+")
        m = F.floor(F.size(w) / 2).cast("int")
        keys = F.array(F.concat(F.lit("<"), F.array_join(F.slice(w, 1, m), " ")), F.concat(F.lit(">"), F.array_join(F.slice(w, m + 1, F.size(w)), " ")))
        return df.where(F.size(w) >= 2).withColumn("half", F.explode(keys)).where("length(half) > 4")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) >= ALIKE for x, y in zip(a, b)], dtype=bool)

    whole = halves(repeated.where("pattern is not null and pages >= 2").select("d", "pattern")).withColumnRenamed("pattern", "whole")
    single = per_doc.where("pattern is not null").join(repeated.select("h", "d"), ["h", "d"], "left_anti").select("d", "h", "pattern")
    near = halves(single).join(whole, ["d", "half"]).where("abs(length(pattern) - length(whole)) <= 4 and whole <> pattern").select("d", "h", "pattern", "whole").distinct()
    near = near.where(alike("pattern", "whole")).select("d", "h").distinct()
    return lines.where("edge").join(near, ["d", "h"], "left_semi").select("doc_id", "page_no", "line_no")


# ---- words ------------------------------------------------------------------------------------------------------


def _clean(line: str) -> str:
    return line if line.isascii() else unicodedata.normalize("NFKC", line)


def body_lines(text: str, furniture) -> list[tuple[int, str]]:
    """(line_no, line) of the non-blank lines that are no furniture."""
    skip = set(furniture) if furniture is not None else set()
    return [(i + 1, _clean(x)) for i, x in enumerate(page_lines(text)) if x.strip() and i + 1 not in skip]


_FIRST_WORD, _LAST_WORD = re.compile(r"\s*([\p{L}\p{M}0-9!|]+)"), re.compile(r"[\p{L}\p{M}0-9!|'’-]+$")
_OF_NUMBER, _NO_DIGIT_MARK = sre.compile(r"[0-9OolISB|!]+(?:[.,/-][0-9OolISB|!]+)*%?"), sre.compile(r"[SBI]|\d[BS]")


def broken_end(line: str) -> tuple[str, str] | None:
    """(start of the word, mark) if the line ends in a hyphen after a letter; NFKC makes a soft hyphen survive."""
    s = line.rstrip()
    if len(s) > 1 and s[-1] in HYPHENS and (s[-2].isalpha() or s[-2] in "0158!|"):
        m = _LAST_WORD.search(s[:-1])
        return (m.group(), s[-1]) if m else None
    return None


def first_word(line: str) -> str:
    m = _FIRST_WORD.match(line)
    return m.group(1) if m else ""


def numeric_misread(token: str) -> bool:
    """A number with letters in place of digits."""
    t = token.removeprefix("FY")
    if not _DIGIT.search(t) or not any(c in t for c in "OolISB|!"):
        return False
    return bool(_OF_NUMBER.fullmatch(t)) and not _NO_DIGIT_MARK.fullmatch(t)


def tokens(line: str) -> list[str]:
    """Words of a line, for the vocabulary and the search for misreadings; numbers and single letters left out."""
    out = []
    for t in _TOKEN.findall(line):
        if t.isalpha():
            if len(t) > 1:
                out.append(t)
            continue
        if t[-1] in "!|’'" and not _BAR_INSIDE.search(t):
            t = t.strip("!|’'")
        if _TWO_LETTERS.search(t) or (len(t) >= 2 and ("!" in t or "|" in t) and _LETTERS.search(t)):
            out.append(t)
    return out


_COMPOUND = sre.compile(r"(?<![\w-])[^\W\d_]+-[^\W\d_]+(?![\w-])")


def compounds(line: str) -> list[str]:
    return _COMPOUND.findall(line) if "-" in line else []


def line_words(lines: list[tuple[int, str]]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(line_no, words, compounds) of body lines, without the parts of words broken at line ends."""
    cut = ""
    for no, line in lines:
        s = line
        if cut:
            w = first_word(s)
            s = s.lstrip()[len(w) :] if w else s
        end = broken_end(line)
        cut = end[0] if end else ""
        if end:
            s = s.rstrip()[: -1 - len(end[0])]
        yield no, tokens(s), compounds(s)


def vocabulary(pages: DataFrame) -> DataFrame:
    """(w, n, f, top, topn): every spelling in body lines of pages (txt, furniture), with its fold and that fold's commonest spelling.

    w is in small letters; compounds with an inner hyphen are counted as such too. All pages count.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for text, skip in zip(pdf["txt"], pdf["furniture"]):
                for _, words, pairs in line_words(body_lines(text, skip)):
                    total.update(w.lower() for w in words)
                    total.update(w.lower() for w in pairs)
            if len(total) > 200_000:
                yield pd.DataFrame(list(total.items()), columns=["w", "n"])
                total = Counter()
        if total:
            yield pd.DataFrame(list(total.items()), columns=["w", "n"])

    v = pages.select("txt", "furniture").mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).withColumn("f", fold(F.col("w")))
    clean = ~F.col("w").rlike(r"[0-9!|]")
    top = v.groupBy("f").agg(F.max(F.struct(F.when(clean, F.col("n")).otherwise(F.lit(0)).alias("n"), "w")).alias("t")).select("f", F.col("t.w").alias("top"), F.col("t.n").alias("topn"))
    return v.join(top, "f")


def _misread_word() -> F.Column:
    return F.expr(f"w <> top and topn >= {OUTNUMBERS} * n and topn >= 2")


def repairs(pages: DataFrame, furniture: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hyphens, misread) of a page_table.

    hyphens: doc_id, page_no, line_no, page_to, line_to, word, head_length: the word that the line breaks, where it goes on,
    and how many of its characters stand before the hyphen.
    misread: doc_id, page_no, line_no, seen, meant: meant is null for numbers.
    """
    skip = furniture.groupBy("doc_id", "page_no").agg(F.collect_list("line_no").alias("furniture"))
    joined = pages.join(skip, ["doc_id", "page_no"], "left")
    vocab = cut_lineage(vocabulary(joined))
    bad = _misread_word()
    total = vocab.agg(F.sum("n").alias("t"))
    odd = F.expr("w rlike '[a-z][0158!|][a-z]' and not w rlike '[0-9]{2}'")
    frequent = vocab.where(~bad & ~odd).join(F.broadcast(total), F.col("n") * FREQUENT >= F.col("t")).select("w")
    known = pages.sparkSession.sparkContext.broadcast({r["w"] for r in frequent.collect()})  # at most FREQUENT words

    cols = ["kind", "doc_id", "page_no", "line_no", "page_to", "line_to", "a", "b"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good = known.value
        for pdf in batches:
            out = []
            for doc, page, text, skip in zip(pdf["doc_id"], pdf["page_no"], pdf["txt"], pdf["furniture"]):
                lines = body_lines(text, skip)
                for no, words, _ in line_words(lines):
                    out += [("word", doc, page, no, None, None, w.lower(), None) for w in set(words) if w.lower() not in good]
                for no, line in lines:
                    for t in _MIXED.findall(line):
                        if numeric_misread(t.strip(".,/-!|") if not (t[-1] in "!|" and t[-2:-1].isdigit()) else t):
                            out.append(("number", doc, page, no, None, None, t, None))
                prose = [x for x in lines if _LETTERS.search(x[1])]
                for (no, line), (to, after) in zip(prose, prose[1:]):
                    end = broken_end(line)
                    if end:
                        out.append(("break", doc, page, no, page, to, end[0] + end[1], first_word(after)))
                if prose:
                    out.append(("head", doc, page, prose[0][0], None, None, first_word(prose[0][1]), None))
                    end = broken_end(prose[-1][1])
                    if end:
                        out.append(("open", doc, page, prose[-1][0], None, None, end[0] + end[1], None))
            if out:
                yield pd.DataFrame(out, columns=cols).astype({"page_to": "Int32", "line_to": "Int32"})

    schema = "kind string, doc_id string, page_no int, line_no int, page_to int, line_to int, a string, b string"
    hits = cut_lineage(joined.select("doc_id", "page_no", "txt", "furniture").mapInPandas(search, schema))

    # a word broken at a page's end goes on at the head of the next page that has prose: one of the three next, or, for
    # the few words without one, the first of all later ones
    heads = hits.where("kind = 'head'").select("doc_id", F.col("page_no").alias("page_to"), F.col("line_no").alias("line_to"), F.col("a").alias("b"))
    offered = heads.withColumn("page_no", F.explode(F.array(*[F.col("page_to") - k for k in (1, 2, 3)])))
    ends = hits.where("kind = 'open'").select("doc_id", "page_no", "line_no", "a")
    following = F.min(F.struct("page_to", "line_to", "b")).alias("n")
    soon = cut_lineage(ends.join(offered, ["doc_id", "page_no"], "left").groupBy("doc_id", "page_no", "line_no", "a").agg(following))
    later = soon.where("n.page_to is null").drop("n").join(heads, "doc_id").where("page_to > page_no").groupBy("doc_id", "page_no", "line_no", "a").agg(following)
    across = soon.where("n.page_to is not null").unionByName(later).select("doc_id", "page_no", "line_no", "n.page_to", "n.line_to", "a", "n.b")
    breaks = hits.where("kind = 'break'").select("doc_id", "page_no", "line_no", "page_to", "line_to", "a", "b").unionByName(across).where("b <> ''")

    folds = vocab.groupBy("f").agg(F.first("top").alias("top"), F.first("topn").alias("topn"))
    head = F.expr("substring(a, 1, length(a) - 1)")
    b = breaks.withColumn("mark", F.expr("right(a, 1)")).withColumn("head", F.element_at(F.split(F.lower(head), "-"), -1)).withColumn("tail", F.lower("b"))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), fold(e).alias("f")) for k, e in (
        ("whole", F.concat("head", "tail")), ("pair", F.concat("head", F.lit("-"), "tail")), ("head", F.col("head")), ("tail", F.col("tail")))])
    # word ends such as "tion" make heavy keys
    found = skew_join_unique(b.withColumn("x", F.explode(keys)).select(*b.columns, "x.k", "x.f"), folds, "f", "left")
    parts = ("whole", "pair", "head", "tail")
    seen = found.groupBy(*b.columns).agg(
        *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("topn"))), F.lit(0)).alias(f"n_{k}") for k in parts],
        *[F.max(F.when(F.col("k") == k, F.col("top"))).alias(f"top_{k}") for k in parts])
    broken = F.expr(f"""
        case when mark in ('{_SOFT[0]}', '{_SOFT[1]}') then true
             when n_pair > n_whole then false
             when n_whole > 0 then true
             when b rlike '^[A-Z]' and head rlike '^[a-z]+$' and a rlike '^[A-Z]' then false
             else not (least(n_head, n_tail) > 2 and least(n_head, n_tail) >= {HALF_SHARE} * t) end""")
    seen = cut_lineage(seen.crossJoin(F.broadcast(total)).withColumn("broken", broken).drop("t"))  # one row
    hyphens = seen.where("broken").select(
        "doc_id", "page_no", "line_no", "page_to", "line_to", F.concat(head, "b").alias("word"), F.length(head).alias("head_length"))

    def torn(condition: str, page: str, line: str, part: str, meant: str) -> DataFrame:
        return seen.where(condition).select("doc_id", F.col(page).alias("page_no"), F.col(line).alias("line_no"), F.col(part).alias("seen"), F.col(meant).alias("meant"))

    whole = "broken and n_whole >= 2 and concat(head, tail) <> top_whole"
    in_breaks = torn(f"{whole} and not startswith(top_whole, head)", "page_no", "line_no", "head", "top_whole")
    in_breaks = in_breaks.unionByName(torn(f"{whole} and not endswith(top_whole, tail)", "page_to", "line_to", "tail", "top_whole"))
    in_breaks = in_breaks.unionByName(torn("not broken and n_head >= 2 and head <> top_head", "page_no", "line_no", "head", "top_head"))
    in_breaks = in_breaks.unionByName(torn("not broken and n_tail >= 2 and tail <> top_tail", "page_to", "line_to", "tail", "top_tail"))
    words = hits.where("kind = 'word'").select("doc_id", "page_no", "line_no", F.col("a").alias("w"))
    misread = words.join(vocab.where(bad | odd).select("w", F.expr(f"case when w <> top and topn >= 1 then top end").alias("top")), "w").select(
        "doc_id", "page_no", "line_no", F.col("w").alias("seen"), F.col("top").alias("meant"))
    figures = hits.where("kind = 'number'").select("doc_id", "page_no", "line_no", F.col("a").alias("seen"), F.lit(None).cast("string").alias("meant"))
    return hyphens, misread.unionByName(in_breaks).unionByName(figures).distinct()


def found_noise(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, kind) with kind furniture, hyphen or ocr, of parsed_pages; see TESTDATA.md.

    Pages without text, doc_id or page_no have no lines; blank pages give nothing; repeated pages count once.
    """
    table = page_table(pages)
    furniture = cut_lineage(furniture_lines(table))
    hyphens, misread = repairs(table, furniture)
    out = furniture.withColumn("kind", F.lit("furniture"))
    out = out.unionByName(hyphens.select("doc_id", "page_no", "line_no", F.lit("hyphen").alias("kind")))
    return out.unionByName(misread.select("doc_id", "page_no", "line_no", F.lit("ocr").alias("kind"))).distinct()


# ---- paragraphs -------------------------------------------------------------------------------------------------


def _like(seen: str, meant: str) -> str:
    return meant.upper() if seen.isupper() and len(seen) > 1 else meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def page_paragraphs(text: str, furniture, joins: dict[int, tuple[str, int]], cuts: set[int], fixes: list[tuple[int, str, str]]) -> list[tuple[bool, str]]:
    """(starts a paragraph, text) of a page's body. joins: line -> (whole word, length of its head); cuts: lines whose first word went up."""
    fix: dict[int, list[tuple[str, str]]] = {}
    for no, seen, meant in fixes:
        fix.setdefault(no, []).append((seen, meant))
    out: list[tuple[bool, str]] = []
    before = None
    for no, line in body_lines(text, furniture):
        s = re.sub(r"\s+", " ", line).strip()
        for seen, meant in fix.get(no, ()):
            if meant is None:
                s = s.replace(seen, seen.translate(_TO_DIGIT) if not seen.startswith("FY") else "FY" + seen[2:].translate(_TO_DIGIT))
            else:
                s = re.sub(rf"(?i)(?<!\p{{L}}){re.escape(seen)}(?!\p{{L}})", lambda m, t=meant: _like(m.group(), t), s)
        if no in cuts:
            w = first_word(s)
            s = s[len(w) :].lstrip() if s[len(w) : len(w) + 1] in (" ", "") else s[len(w) :]
        if no in joins:
            word, n = joins[no]
            s = s[: -1 - n] + word
        fresh = before is not None and no != before + 1 and any(not x.strip() for x in page_lines(text)[before : no - 1])
        first = before is None
        before = no
        if not s:
            continue
        if first and not out:
            out.append((not (s[:1].islower() or no in cuts), s))
        elif fresh:
            out.append((True, s))
        else:
            glue = "" if re.match(r"[.,;:)]", s) and no in cuts else " "
            out[-1] = (out[-1][0], out[-1][1] + glue + s) if out else (True, s)
    return out


def paragraphs(pages: DataFrame, block: int = 256) -> DataFrame:
    """(doc_id, para_no, page_from, page_to, text): the continuous paragraphs of each filing, in order from 0.

    A page whose body starts with a small letter or the rest of a word goes on with the paragraph of the page before.
    Paragraphs are numbered by sums over blocks of pages and then over blocks, so no task sees a whole long document.
    """
    table = page_table(pages)
    furniture = cut_lineage(furniture_lines(table))
    hyphens, misread = repairs(table, furniture)
    key = ["doc_id", "page_no"]
    skip = furniture.groupBy(*key).agg(F.collect_list("line_no").alias("furniture"))
    joins = hyphens.groupBy(*key).agg(F.collect_list(F.struct("line_no", "word", "head_length")).alias("joins"))
    cuts = hyphens.select("doc_id", F.col("page_to").alias("page_no"), F.col("line_to").alias("line_no")).groupBy(*key).agg(F.collect_list("line_no").alias("cuts"))
    fixes = misread.groupBy(*key).agg(F.collect_list(F.struct("line_no", "seen", "meant")).alias("fixes"))

    @F.pandas_udf("array<struct<opens:boolean,part:string>>")
    def parts(txt: pd.Series, f: pd.Series, j: pd.Series, c: pd.Series, x: pd.Series) -> pd.Series:
        rows = []
        for text, skip, jo, cu, fi in zip(txt, f, j, c, x):
            j_ = {r["line_no"]: (r["word"], r["head_length"]) for r in (jo if jo is not None else [])}
            f_ = [(r["line_no"], r["seen"], r["meant"]) for r in (fi if fi is not None else [])]
            rows.append([{"opens": o, "part": p} for o, p in page_paragraphs(text, skip, j_, set(cu) if cu is not None else set(), f_)])
        return pd.Series(rows, dtype=object)

    all_ = table
    for other in (skip, joins, cuts, fixes):
        all_ = all_.join(other, key, "left")
    done = cut_lineage(all_.select(*key, parts("txt", "furniture", "joins", "cuts", "fixes").alias("parts")))
    starts = done.select(*key, F.floor(F.col("page_no") / block).alias("blk"), F.size(F.filter("parts", lambda p: p["opens"])).alias("k"))
    per_block = starts.groupBy("doc_id", "blk").agg(F.sum("k").alias("bk"))
    ahead = Window.partitionBy("doc_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("base", F.coalesce(F.sum("bk").over(ahead), F.lit(0))).select("doc_id", "blk", "base")
    within = Window.partitionBy("doc_id", "blk").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = starts.withColumn("in_block", F.coalesce(F.sum("k").over(within), F.lit(0))).join(per_block, ["doc_id", "blk"]).select(*key, (F.col("base") + F.col("in_block")).alias("offset"))
    flat = done.join(offset, key).select(*key, "offset", F.posexplode(F.expr(
        "transform(parts, (p, i) -> struct(p.part as part, size(filter(slice(parts, 1, i + 1), x -> x.opens)) as nth))")).alias("i", "p"))
    flat = flat.select("doc_id", "page_no", "i", (F.col("offset") + F.col("p.nth") - 1).alias("para_no"), "p.part")
    return flat.groupBy("doc_id", F.greatest("para_no", F.lit(0)).alias("para_no")).agg(
        F.min("page_no").alias("page_from"), F.max("page_no").alias("page_to"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "i", "part"))), lambda x: x["part"]), " ").alias("text"))

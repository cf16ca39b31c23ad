"""Personal data in free text: finding and replacing by typed placeholders."""

from __future__ import annotations

import re as sre
from bisect import bisect_left
from collections.abc import Container, Iterator
from typing import NamedTuple

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: A span counts from this score on.
ACCEPT = 0.5
#: Characters before and after a span whose words count as context.
NEAR = 40

# ---- checksums --------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Luhn's check of a payment card number."""
    d = [int(c) for c in digits if c.isdigit()]
    return len(d) > 1 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10, as of bank account numbers."""
    s = "".join(c for c in iban.upper() if c.isalnum())
    return len(s) > 4 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def verhoeff(digits: str) -> bool:
    """Verhoeff's check, from the dihedral group of ten elements."""
    def mul(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value: the permutation of the scheme
    c = 0
    for i, ch in enumerate(reversed([x for x in digits if x.isdigit()])):
        x = int(ch)
        for _ in range(i % 8):
            x = step[x]
        c = mul(c, x)
    return c == 0


# ---- spans ------------------------------------------------------------------------------------------------------


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


_AT = r"(?: ?@ ?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w.+%-]*\w(?:{_AT})\w[\w-]*(?:{_DOT}\w[\w-]*)+(?![\w@])", re.I)
EMAIL_WORDS = re.compile(r"(?<![\w.+%-])[\w.+%-]*[\w]\s(?:at|AT)\s[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+(?!\w)")
#: What stands between the parts of an address; the search for addresses starts from these.
_AT_SIGN = sre.compile(r"@|[\[({]\s?at\s?[\])}]", sre.I)
_AT_WORD = sre.compile(r"\s(?:at|AT)\s[\w-]+\s(?:dot|DOT)\s")
#: Where a number of a person may start; texts without one are not searched for numbers.
_LONG_NUMBER = sre.compile(r"\d(?:[ ().-]{0,2}\d){6,}")
PHONE = sre.compile(
    r"(?<![\w.,/+#(₹$-])(?:"
    r"(?:\+|00)\d{1,3}[ -]?\(?\d{1,4}\)?(?:[ .-]?\d{2,6}){1,4}"
    r"|\(0?\d{2,4}\)[ -]?\d{3,4}[ -]?\d{4}"
    r"|0\d{2,4}-\d{3,4}[ -]?\d{3,4}"
    r"|1800[ -]\d{3}[ -]\d{3,4}"
    r"|0?[5-9]\d{4}[ -]?\d{5}"
    r"|0[5-9]\d{9}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|[5-9]\d{9}"
    r")(?![\w/]|[.,-]\d)")
PAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{3}P[A-Z]\d{4}[A-Z](?![A-Za-z0-9])")
AADHAAR = re.compile(r"(?<![\w/.,+-])\d{4}([ -]?)\d{4}\1\d{4}(?![\w/]|[.,-]\d)")
CARD = sre.compile(r"(?<![\w/.,+-])(?:[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w/]|[.,-]\d)")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9/-])[A-Z]\d{7}(?![A-Za-z0-9/])")
VOTER = re.compile(r"(?<![A-Za-z0-9/-])[A-Z]{3}\d{7}(?![A-Za-z0-9/])")
DIN = re.compile(r"(?<![\w/.,+-])\d{8}(?![\w/]|[.,-]\d)")

_CONTEXT = {
    "phone": re.compile(r"(?i)\b(?:tel|phone|fax|mobile|mob|call|reached on|ring|dial|whatsapp|helpline|contact|toll[ -]?free|desk)\b|दूरभाष|फ़ोन|फोन|मोबाइल|संपर्क"),
    "aadhaar": re.compile(r"(?i)\b(?:aadhaar|aadhar|uid|uidai|resident identity)\b|आधार"),
    "passport": re.compile(r"(?i)\bpassport\b|पासपोर्ट"),
    "voter": re.compile(r"(?i)\b(?:epic|voter|elector)\b|मतदाता"),
    "din": re.compile(r"(?i)\bDIN\b|director identification"),
    "pan": re.compile(r"(?i)\bPAN\b|permanent account"),
    "other": re.compile(r"(?i)\b(?:scrip|order|invoice|folio|gstin|cin|policy|receipt|ticket|docket|isin|srn|ref(?:erence)?|challan|sum of|amount)\b[^.;\n]{0,14}$"),
}

#: Last words of street names.
_STREET = r"(?:Road|Street|Lane|Avenue|Marg|Path|Nagar|Colony|Salai|Chowk|Bazaar|Layout|Enclave|Sector \d+|Cross|Main)"
_POST = r"[1-9]\d{2} ?\d{3}(?![\d,.]\d|\d)"
_HEAD = r"(?:(?:Flat|House|Door|Plot|H\.? ?No\.?|No\.|Shop|Unit|Block)\.?(?: No\.?)? ?#?\d[\w/-]*|(?<![\w.,/-])\d{1,4}[A-Z]?(?:/\d+)?)"
_PART = r"[A-Z][\w.']*(?:[ ][A-Z0-9][\w.']*){0,4}"
ADDRESS = re.compile(rf"(?<!\w)(?:{_HEAD}),?(?: ?(?:{_PART}),[ \n]?){{1,4}}\s?[A-Z][a-z]+(?: [A-Z][a-z]+)?(?:\s?[-–]\s?{_POST}|,? {_POST})?")
_STREET_IN = re.compile(rf"\b{_STREET}\b")

#: Titles before a name, which are no part of it.
TITLES = "Mr Mrs Ms Miss Shri Smt Sri Dr Prof Kum Kumari CA Adv".split()
_TITLE = rf"(?:{'|'.join(TITLES)})\.?"
#: Words that close a letter before the name of its writer.
_CLOSES = ("By order of the Board", "Yours faithfully", "Yours sincerely", "Yours truly", "Thanks", "Thank you", "Thanks and regards", "Thank you and regards", "Regards", "Warm regards", "Best regards", "Kind regards", "Warm Regards", "Best Regards", "Kind Regards", "Sincerely", "भवदीय")
#: What is said of persons only, so that a name stands before or after it, in capitals or not.
_ONLY_PERSONS_DO = sre.compile(r" raised a query| noted,|: Thank you| को सूचना| was (?:re-?)?appointed (?:Non|Nominee|Indep|Whole|Managing|Chief|Company|Chair|as)|, holding DIN| \(DIN| resigned| retired| ceased to be")
_TO_PERSONS = sre.compile(r"\b(?:thanked|imposed on|As|AS)\s+")
#: Words beside names and other things; they count only together with other evidence.
_BESIDE_AFTER = sre.compile(r",? (?:said|asked|added|replied|stated|observed|explained|enquired|remarked|joined|wrote|spoke|requested|proposed|seconded|who|aged|[Dd]irector|[Ss]on of|[Dd]aughter of)\b|, \(|'s\b|’s\b| ने\b| की\b")
_BESIDE_BEFORE = sre.compile(r"(?:\b(?:thanked|issued to|addressed to|signed by|received from|met|made by|by|to|from|with|contact|Attn|Attention|name of|person|Dear|behalf of|spoke to|called|applicant|complainant|holder|nominee|appointed)[:,]?|\bimposed on) $", sre.I)
_WORD = r"(?:[A-ZÀ-Þ][a-zß-ÿ'’]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?|[A-ZÀ-Þ]{2,}|[A-ZÀ-Þ]\.?)"
#: A run of capitalised words, the place to look for names.
_RUN = sre.compile(rf"(?<![\w.@-]){_WORD}\.?(?:(?:,? {{1,2}}|(?<=\.)){_WORD}\.?(?![^\W_])){{1,6}}")
_SENTENCE = sre.compile(r"(?:^|[.!?;:।\n])\s*$")
_ANY = r"\p{L}[\p{L}\p{M}'’.-]*"
_ANY_NAME = rf"{_ANY},?(?: {{1,2}}{_ANY}){{1,4}}"
_FRAMED = re.compile(rf"(?:{_TITLE}\s+)?(?P<n>{_ANY_NAME}?)(?= (?:for the services|under the|noted,))", re.I)
_SIGNED = re.compile(rf"\s*(?:{_TITLE}\s+)?(?P<n>{_ANY_NAME})(?=[ ]*(?:\n|$|[<&]|[^\p{{L}}\p{{N}}\p{{P}}\s]))")
_OPENS = re.compile(rf"(?:^|[.;:।\n]\s|\n)(?:{_TITLE}\s+)?(?P<n>{_ANY},?(?: {{1,2}}{_ANY}){{1,3}})$")
_TITLED_ANY = re.compile(rf"(?<!\p{{L}}){_TITLE}\s+(?P<n>{_ANY_NAME}?)(?= (?:for the|under the|noted,|raised a|was appointed))")
_FIRM = re.compile(r"^[ ]*(?:&|and|,)?[ ]*(?:& )?(?:Associates|Co\b|Company|LLP|Limited|Ltd|Private|Pvt|Corporation|Corp|Group|Sons|Partners|Chartered)|^ & ")
#: Words that make a capitalised phrase no person's name.
_NOT_NAMES = set(
    "the a an this that board committee audit company limited private corporation llp ltd pvt bank bench tribunal exchange securities authority commission "
    "court ministry government department registrar director directors officer secretary chairperson chairman chief executive managing whole time "
    "independent nominee shareholders members member investor investors team sir madam respected hello dear note annual report notice order operator moderator "
    "management stakeholders relationship nomination remuneration risk responsibility social corporate sustainability appellate commodities competition banking "
    "holdings finance industries services infrastructure engineering as by in of on at to from with and or no all good morning afternoon evening thank you "
    "mr mrs ms shri smt dr capacity provision revenue goodwill pledged trade other related cash during management analysts shares address call tel mobile".split())


_STOPS_AT = sre.compile(r"[^\d\n.;]*")
_LABEL_AFTER = sre.compile(r"\s*(?:\([^()]*\))?")


#: Last words of runs that are no names, whatever stands before.
_NOT_LAST = set("limited ltd llp corporation private company committee board bench tribunal exchange authority commission bank".split())


def _near(text: str, a: int, b: int, kind: str) -> bool:
    if _CONTEXT[kind].search(text[max(0, a - NEAR) : a]):
        return True
    if kind == "other":
        return False
    # a word after the span counts within its line and sentence, unless a further number follows, whose label it may be
    after = _STOPS_AT.match(text[b : b + NEAR]).group()
    if b + len(after) < len(text) and text[b + len(after)].isdigit():
        after = _LABEL_AFTER.match(after).group()
    return bool(_CONTEXT[kind].search(after))


def _check_digit(number: str) -> bool:
    """An Aadhaar number's first digit and Verhoeff's check; three years in a row are none."""
    return number[0] in "23456789" and verhoeff(number) and not re.fullmatch(r"(?:(?:19|20)\d\d[ -]?){3}", number)


_NAME_PART = re.compile(r"[\p{L}\p{M}'’-]+\.?")
_TITLE_WORDS = {t.lower() for t in TITLES}


def _foreign(w: str) -> bool:
    return w.lower().strip(".") in _NOT_NAMES and not (len(w.strip(".")) == 1 and w[0].isupper())


def _trimmed(text: str, words: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """words without those that belong to no name at either end; empty if no two are left."""
    while words and _foreign(words[0][2]):
        words = words[1:]
    for i, w in enumerate(words):
        if i and _foreign(w[2]):
            words = words[:i]
            break
    return words if len(words) >= 2 and any(len(w[2].strip(".")) > 2 for w in words) else []


def _parts(text: str, s: int, e: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _NAME_PART.finditer(text, s, e)]


def _bounds(text: str, words: list[tuple[int, int, str]]) -> tuple[int, int]:
    end = words[-1][1]
    if text[end - 2 : end] in ("'s", "’s") and len(words[-1][2]) > 4:
        return words[0][0], end - 2
    return words[0][0], end - 1 if text[end - 1] == "." and len(words[-1][2]) > 2 else end


def _segments(text: str, words: list[tuple[int, int, str]]) -> Iterator[tuple[bool, list[tuple[int, int, str]]]]:
    """(after a title, words) of the parts of a run, cut before titles and at commas but the one of 'Surname, Given'."""
    part: list[tuple[int, int, str]] = []
    titled = False
    for i, w in enumerate(words):
        if w[2].lower().strip(".") in _TITLE_WORDS and i + 1 < len(words) and not (w[2] == "CA" and part):
            if part:
                yield titled, part
            part, titled = [], True
            continue
        if part and "," in text[part[-1][1] : w[0]] and len(part) > 1:
            yield titled, part
            part, titled = [], False
        part.append(w)
    if part:
        yield titled, part


def _closes(text: str) -> Iterator[int]:
    """Ends of the lines that close a letter."""
    end = text.find("\n")
    while end >= 0:
        if text[text.rfind("\n", 0, end) + 1 : end].rstrip(" ,\r").endswith(_CLOSES):
            yield end
        end = text.find("\n", end + 1)


def _names(text: str, given: Container[str]) -> Iterator[Span]:
    """Spans that may be names, with their scores.

    Runs of capitalised words are scored by what is beside them and in them: a title decides; a given name of the
    vocabulary, initials before a word, words of persons on either side add up. Names in any case are taken where both
    sides are fixed by words that only persons stand between, after a letter's close, or where a given name follows
    a word such as 'by' or 'to'.
    """
    def offer(words: list[tuple[int, int, str]], score: float) -> Iterator[Span]:
        if words:
            s, e = _bounds(text, words)
            if not _FIRM.match(text[e : e + 24]) and not any(_FIRM.match(w[2]) for w in words):
                yield Span(s, e, "name", score)

    for m in _RUN.finditer(text):
        s, e = m.span()
        if "." not in m.group() and m.group().rsplit(" ", 1)[-1].lower() in _NOT_LAST:
            continue  # a firm or a body
        for titled, part in _segments(text, _parts(text, s, e)):
            words = _trimmed(text, part)
            if not words or (len(words) > 5 and not titled) or _STREET_IN.search(text[words[0][0] : words[-1][1]]):
                continue
            words = words[:5]
            if len(words) > 2 and not titled and words[0][2].lower() not in given and words[1][2].lower() in given and _SENTENCE.search(text[max(0, words[0][0] - 3) : words[0][0]]):
                words = words[1:]  # the capital of the first word is that of the sentence
            begin, end = _bounds(text, words)
            first = words[1 if text[words[0][1] : words[0][1] + 1] == "," else 0][2]
            score = 0.9 if titled else 0.1
            if not titled:
                score += 0.5 * (first.lower().strip(".") in given)
                score += 0.4 * (len(first.strip(".")) == 1 and len(words[-1][2]) > 2)
                score += 0.7 * bool(_ONLY_PERSONS_DO.match(text, end))
                score += 0.3 * bool(_BESIDE_AFTER.match(text, end)) + 0.3 * bool(_BESIDE_BEFORE.search(text[max(0, begin - 20) : begin]))
            if score >= ACCEPT:
                yield from offer(words, score)
    for m in _TITLED_ANY.finditer(text):
        yield from offer(_trimmed(text, _parts(text, *m.span("n"))), 0.85)
    for at in _TO_PERSONS.finditer(text):
        m = _FRAMED.match(text, at.end())
        if m:
            yield from offer(_trimmed(text, _parts(text, *m.span("n"))), 0.8)
        elif given:
            words = _parts(text, at.end(), at.end() + 60)
            if words and words[0][2].lower() in given:
                yield from offer(_trimmed(text, words[:2]), 0.6)
    for at in _ONLY_PERSONS_DO.finditer(text):
        base = max(0, at.start() - 100)
        m = _OPENS.search(text[base : at.start()])
        if m:
            yield from offer(_trimmed(text, _parts(text, base + m.start("n"), base + m.end("n"))), 0.8)
    for at in _closes(text):
        m = _SIGNED.match(text, at)
        if m:
            words = _parts(text, *m.span("n"))
            small = [i for i, w in enumerate(words) if w[2][0].islower()]
            # a name in small letters is one as a whole; after capitals small letters are mark-up
            yield from offer(_trimmed(text, words[: small[0]] if small and small[0] else words), 0.9)


def _addresses_for_mail(text: str) -> Iterator[Span]:
    for at in _AT_SIGN.finditer(text):
        s = at.start()
        s -= s > 0 and text[s - 1].isspace()
        while s and (text[s - 1].isalnum() or text[s - 1] in "_.+%-"):
            s -= 1
        m = EMAIL.match(text, s)
        if m:
            yield Span(m.start(), m.end(), "email", 0.9)
    if _AT_WORD.search(text):
        for m in EMAIL_WORDS.finditer(text):
            yield Span(m.start(), m.end(), "email", 0.7)


def _numbers(text: str) -> Iterator[Span]:
    """Numbers of persons; see find_spans for what decides."""
    for m in IBAN.finditer(text):
        if mod97(m.group()):
            yield Span(m.start(), m.end(), "id_number", 0.9)
    for pattern, label, base in ((PAN, "pan", 0.6), (PASSPORT, "passport", 0.2), (VOTER, "voter", 0.2)):
        for m in pattern.finditer(text):
            yield Span(m.start(), m.end(), "id_number", base + 0.5 * _near(text, *m.span(), label) - 0.3 * _near(text, *m.span(), "other"))
    if not _LONG_NUMBER.search(text):
        return
    for m in AADHAAR.finditer(text):
        yield Span(m.start(), m.end(), "id_number", 0.3 + 0.5 * _near(text, *m.span(), "aadhaar") + 0.3 * _check_digit(m.group()) - 0.4 * _near(text, *m.span(), "other"))
    for m in CARD.finditer(text):
        if luhn(m.group()):
            yield Span(m.start(), m.end(), "id_number", 0.7 - 0.4 * _near(text, *m.span(), "other"))
    for m in DIN.finditer(text):
        yield Span(m.start(), m.end(), "id_number", 0.3 + 0.5 * _near(text, *m.span(), "din") - 0.3 * _near(text, *m.span(), "other"))
    for m in PHONE.finditer(text):
        clear = m.group()[0] in "+(" or m.group().startswith(("00", "1800"))
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield Span(m.start(), m.end(), "phone", 0.3 + 0.2 * clear + 0.4 * _near(text, *m.span(), "phone") - 0.4 * _near(text, *m.span(), "other"))


def find_spans(text: str | None, given: Container[str] = frozenset()) -> list[Span]:
    """Spans of personal data in text, by position; of overlapping ones the better scored stays, then the kind
    named first in KINDS, then the longer.

    Patterns propose spans. Checksums and the words near a span then move its score: an Aadhaar number needs its label
    or Verhoeff's check, card numbers need Luhn's and IBANs mod 97, a bare run of ten digits needs a word for telephones,
    eight digits need the label DIN. Numbers after a word such as order or scrip are none of a person's. given holds
    given names in small letters, see given_names; without it names need a title, initials or words of persons beside
    them. Null and empty text have no spans.
    """
    if not text:
        return []
    got = [*_addresses_for_mail(text), *_numbers(text)]
    got += [Span(m.start(), m.end(), "address", 0.8) for m in ADDRESS.finditer(text) if _STREET_IN.search(m.group())]
    got += _names(text, given)
    order = {k: i for i, k in enumerate(KINDS)}
    kept: list[Span] = []
    for x in sorted((x for x in got if x.score >= ACCEPT), key=lambda x: (-(x.kind in ("email", "address")), -x.score, order[x.kind], x.start - x.end, x.start)):
        i = bisect_left(kept, x.start, key=lambda y: y.start)
        if (i == 0 or kept[i - 1].end <= x.start) and (i == len(kept) or x.end <= kept[i].start):
            kept.insert(i, x)
    return kept


def redact_text(text: str | None, spans: list[Span]) -> str | None:
    """text with each span replaced by [KIND]; everything else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:int,end:int,score:double,found_value:string>>"
#: A word is a given name of the vocabulary when it stands first in this share of all names after titles or closes, so
#: there are at most 1 / VOCABULARY such words to send to every task.
VOCABULARY = 1 / 20_000


def given_names(texts: DataFrame, text_col: str) -> frozenset[str]:
    """Given names in small letters: first words after a title or a letter's close, before another capitalised word.

    All texts count; a built-in expression over each, so no Python worker sees them.
    """
    t = F.col(text_col)
    # a letter's close is looked for from the line end after it, so that few places are tried
    close = rf"\n(?<=(?:{'|'.join(_CLOSES)}),?[ ]{{0,2}}\n)\n*[ ]*"
    title = r"[MSDPKCA](?<!\p{L}.)(?:rs?|s|iss|hri|mt|ri|rof|um(?:ari)?|A|dv)\.?\s+"
    pattern = rf"(?:{title}|{close})(\p{{Lu}}\p{{Ll}}{{2,}}) \p{{Lu}}"
    words = texts.where(t.isNotNull()).select(F.explode(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))).alias("w")).select(F.lower("w").alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    usual = counts.join(F.broadcast(total), F.col("n") >= F.col("t") * F.lit(VOCABULARY)).select("w")
    return frozenset(r["w"] for r in usual.collect() if r["w"] not in _NOT_NAMES)  # at most 1 / VOCABULARY words


def personal_data(text: Column, given: Container[str] = frozenset()) -> Column:
    """Array of (kind, start, end, score, found_value) of a string column; offsets in code points; empty for null."""

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[
                {"kind": x.kind, "start": x.start, "end": x.end, "score": x.score, "found_value": t[x.start : x.end]} for x in find_spans(t, given)
            ] for t in s], dtype=object)

    return run(text)


def redact(text: Column, given: Container[str] = frozenset()) -> Column:
    """The string column with personal data replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME]; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([redact_text(t, find_spans(t, given)) for t in s], dtype=object)

    return run(text)


def found_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, found_value), distinct, of all rows of df."""
    full = df.where(f"`{text_col}` is not null and `{text_col}` <> ''")
    spans = full.select(F.col(id_col), F.explode(personal_data(F.col(text_col), given_names(full, text_col))).alias("s"))
    return spans.select(id_col, "s.kind", "s.found_value").distinct()

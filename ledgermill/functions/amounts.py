"""Reading of printed amounts: number, scale and currency."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Scale words and their factors.
SCALES = {
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "mln": 1e6,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "trillion": 1e12, "tn": 1e12,
    "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "000s": 1e3, "000's": 1e3, "'000s": 1e3,
}
#: Words for whole units.
WHOLE = r"whole rupees|in rupees|rupees only|\bunits\b"
#: Currency signs and codes, the longer first.
CURRENCIES = [
    (r"U\.?\s?S\.?\s?\$|US\$|\bUSD\b|\bdollars?\b", "USD"), (r"S\$|\bSGD\b", "SGD"), (r"€|\bEUR\b|\beuros?\b", "EUR"),
    (r"£|\bGBP\b", "GBP"), (r"¥|\bJPY\b|\byen\b", "JPY"), (r"₹|\bINR\b|\bRs\b\.?|\bRs\.?(?=\d)|\brupees?\b|\bH(?=\s?\d)|`(?=\s?\d)", "INR"),
    (r"\$", "USD"),
]
_CUR = [(re.compile(p, re.I if not p.startswith("₹") else re.I), c) for p, c in CURRENCIES]
_SCALE = re.compile(
    r"(?<![A-Za-z])(crores?|crs?|lakhs?|lacs?|millions?|mn|mio|mln|billions?|bn|bln|trillion|tn|thousands?)(?![A-Za-z])"
    r"|(?<![\d,.])(['’]000s?|000['’]?s)(?!\d)|(?<=\d )(000s)(?!\d)", re.I)
_NUM = re.compile(r"\d[\d,]*(?:\.\d+)?")
_WHOLE = re.compile(WHOLE, re.I)
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_WORDS = {w: i for i, w in enumerate(_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}


class Amount(NamedTuple):
    value: float | None  # the number as printed, compound scales already in units of the smallest factor 1
    factor: float | None  # None: no unit stated
    currency: str | None  # None: no currency stated


def currency_of(text: str) -> str | None:
    for p, c in _CUR:
        if p.search(text):
            return c
    return None


def scale_of(text: str) -> float | None:
    """Factor of the first scale word; 1 for words that say whole units; None if there is neither."""
    m = _SCALE.search(text)
    if m:
        return SCALES[next(x for x in m.groups() if x).lower().replace("’", "'")]
    return 1.0 if _WHOLE.search(text) else None


def _spelled(text: str) -> float | None:
    """An amount in words with scale words, such as 'Eleven crore Sixty lakh'; None if it is none."""
    total = part = 0.0
    seen = False
    for w in re.findall(r"[a-z]+", text.lower()):
        if w in _WORDS:
            part += _WORDS[w]
            seen = True
        elif w == "hundred":
            part = (part or 1) * 100
        elif w in SCALES:
            total += (part or 1) * SCALES[w]
            part = 0.0
        elif w not in ("rupees", "rupee", "and", "only", "rs", "inr", "about"):
            return None
    return total + part if seen else None


def numbers(text: str) -> list[float]:
    return [float(x.replace(",", "")) for x in _NUM.findall(text) if x.strip(",")]


def read_amount(text: str | None) -> Amount:
    """Value, factor and currency stated in a printed amount.

    Compound scales ('15 Cr 26 Lacs') and words ('Eleven crore only') come out as a value of factor 1. A currency sign
    without a scale word means whole units. A negative in brackets keeps its sign. No number: value None.
    """
    if text is None or not text.strip():
        return Amount(None, None, None)
    cur = currency_of(text)
    bare = re.sub(r"\((?:[a-z]|[ivx]+|note[^)]*)\)|\*+|/-|/=", " ", text)
    marks = re.sub(r"(?<![\d,.])['’]000s?|(?<![\d,])000['’]?s(?!\d)", " ", bare)
    found = list(_NUM.finditer(marks))
    sign = -1.0 if re.search(r"\(\s*[^\d()]{0,4}\d[\d,.]*\s*\)|(?:^|\s)[-−]\s?\d", marks) else 1.0
    if not found:
        v = _spelled(bare)
        return Amount(v, 1.0 if v is not None else None, cur or ("INR" if v is not None else None))
    parts = []
    for i, m in enumerate(found):
        tail = marks[m.end() : found[i + 1].start() if i + 1 < len(found) else len(marks)]
        s = _SCALE.match(tail.lstrip(" -"))
        parts.append((float(m.group().replace(",", "")), SCALES[s.group().lower()] if s else None))
    if len(parts) > 1 and parts[0][1] and parts[1][1] and parts[1][1] < parts[0][1]:
        return Amount(sign * (parts[0][0] * parts[0][1] + parts[1][0] * parts[1][1]), 1.0, cur or "INR")
    factor = scale_of(bare)
    if factor is None and cur is not None:
        factor = 1.0
    return Amount(sign * parts[0][0], factor, cur)


def read_unit(text: str | None) -> tuple[float | None, str | None]:
    """(factor, currency) of a unit such as 'Rs. Million', '₹ crore', "'000"; (None, None) if it is no unit of money."""
    if text is None or not text.strip():
        return None, None
    cur = currency_of(re.sub(r"(?i)\brupees\b", "INR", text))
    factor = scale_of(text)
    return (1.0 if factor is None and cur else factor), cur

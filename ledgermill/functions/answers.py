"""Answers and questions as text: normalising, scoring, numbers, claims, labels and the calculator."""

from __future__ import annotations

import ast
import json
import math
import operator
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgermill.functions.fuzzy import sorted_ratio

#: Similarity from which two entity names are one, and the share by which numbers may differ.
ALIKE, TOLERANCE = 92, 0.01
#: Words an answer is compared without.
ANSWER_SUFFIXES = r"\b(llp|ltd|limited|pvt|private|co|company|the)\b"
#: Scale word -> crore.
IN_CRORE = {"crore": 1.0, "lakh": 0.01, "million": 0.1, "billion": 100.0}
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def norm_answer(c: Column) -> Column:
    """Small letters without M/s, marks and legal forms; & is and; single spaces."""
    c = F.replace(F.regexp_replace(F.lower(c), r"\bm\s*/\s*s\b\.?", " "), F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]+", " "), ANSWER_SUFFIXES, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and (x == y or sorted_ratio(x, y) >= ALIKE) for x, y in zip(a, b)], dtype=bool)


def same_entity(a: Column, b: Column) -> Column:
    """True for normalised names that are equal or alike; false if either is empty."""
    x, y = norm_answer(a), norm_answer(b)
    some = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    return some & _alike(F.when(some, x), F.when(some, y))


@F.pandas_udf(T.DoubleType())
def list_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of two arrays of normalised names, each matched if any of the other is alike; both empty 1, one empty 0."""
    def hit(x: str, others) -> bool:
        return any(x and y and (x == y or sorted_ratio(x, y) >= ALIKE) for y in others)

    out = []
    for p, g in zip(a, b):
        p, g = list(p) if p is not None else [], list(g) if g is not None else []
        if not p or not g:
            out.append(float(not p and not g))
            continue
        precision, recall = sum(hit(x, g) for x in p) / len(p), sum(hit(x, p) for x in g) / len(g)
        out.append(0.0 if precision + recall == 0 else 2 * precision * recall / (precision + recall))
    return pd.Series(out)


def number_in_crore(c: Column) -> Column:
    """First number of a text in crore: by the first scale word of crore, lakh, million, billion; a bare million or more is rupees."""
    x = F.regexp_replace(F.nullif(F.regexp_extract(c, f"({NUMBER})", 1), F.lit("")), ",", "").try_cast("double")
    out = F.lit(None).cast("double")
    for word, factor in reversed(IN_CRORE.items()):
        out = F.when(F.lower(c).contains(word), x * factor).otherwise(out)
    return F.coalesce(out, F.when(x >= 1e6, x / 1e7).otherwise(x))


def score_answer(kind: Column, given: Column, gold: Column) -> Column:
    """1 or 0, for lists their F1, by the kind of answer: entity, yes_no, number, list; null for other kinds.

    A null answer counts as empty. A number is right within TOLERANCE of the gold number in crore.
    """
    p, g = F.coalesce(given, F.lit("")), F.coalesce(gold, F.lit(""))
    parts = lambda c: F.transform(F.filter(F.transform(F.split(c, "[;\n]"), lambda x: F.trim(x)), lambda x: x != ""), norm_answer)
    first = F.element_at(F.split(norm_answer(p), " "), 1)
    value, want = number_in_crore(p), g.try_cast("double")
    none = F.array().cast("array<string>")
    return (F.when(kind == "entity", same_entity(p, g).cast("double"))
            .when(kind == "yes_no", ((first != "") & (first == norm_answer(g))).cast("double"))
            .when(kind == "number", F.coalesce(F.abs(value - want) <= TOLERANCE * F.abs(want), F.lit(False)).cast("double"))
            .when(kind == "list", list_f1(F.when(kind == "list", parts(p)).otherwise(none), F.when(kind == "list", parts(g)).otherwise(none))))


def number_supported(answer: Column, evidence: Column) -> Column:
    """True if a number of the answer, as printed or in crore, is within TOLERANCE of one in the evidence, or it has none."""
    def values(c: Column) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())

    crore = number_in_crore(answer)
    asked = F.filter(F.concat(values(answer), F.array(crore)), lambda x: x.isNotNull())
    close = lambda a, b: F.abs(a - b) <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    seen = values(F.coalesce(evidence, F.lit("")))
    return (F.size(asked) == 0) | F.exists(asked, lambda a: F.exists(seen, lambda b: close(a, b)))


def checked_claim(verdict: Column, labels: Column, known: Column) -> Column:
    """Struct of verdict and labels: labels that do not exist go, and SUPPORTED without one is UNSUPPORTED."""
    good = F.filter(labels, lambda x: F.array_contains(known, x))
    return F.struct(F.when((verdict == "SUPPORTED") & (F.size(good) == 0), "UNSUPPORTED").otherwise(verdict).alias("verdict"), good.alias("labels"))


def marker_tokens(c: Column) -> Column:
    """Array of (kind, value) of a text with markers such as [E1, E2]: text between markers, and one marker a label."""
    marked = F.regexp_replace(c, r"\[\s*(E\d+(?:\s*,\s*E\d+)*)\s*\]", "\u0001$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    one = lambda x: F.when(x.rlike(r"^E\d+(\s*,\s*E\d+)*$"), F.transform(F.regexp_extract_all(x, F.lit(r"(E\d+)"), F.lit(1)), lambda e: F.struct(F.lit("marker").alias("kind"), e.alias("value")))).otherwise(
        F.array(F.struct(F.lit("text").alias("kind"), x.alias("value"))))
    return F.flatten(F.transform(parts, one))


#: Words that open a question and belong to no name.
QUESTION_WORDS = [
    "who", "what", "which", "when", "where", "why", "how", "is", "are", "was", "were", "did", "does", "do", "list", "name", "show", "tell", "give", "find",
    "the", "a", "an", "in", "of", "for", "and", "between", "compare",
]
_YEAR = re.compile(r"FY\s?\d{4}\s?-\s?\d{2}|FY\d.*", re.I)


def capital_phrases(question: str) -> list[str]:
    """Runs of capitalised words (joined by &, of, and, for) without question words at the front, in order, each once."""
    out: list[str] = []
    for run in re.findall(r"[A-Z][\w&.'-]*(?:\s+(?:&|of|and|for|[A-Z][\w&.'-]*))*", question):
        words = run.split()
        start = next((i for i, w in enumerate(words) if w.lower().strip(".,?") not in QUESTION_WORDS), len(words))
        end = next((i for i in range(len(words), start, -1) if words[i - 1].lower() not in ("and", "of", "for", "&")), start)
        name = re.sub(r"(?i)^(?:mr|mrs|ms|shri|smt|sri)\.?\s+", "", " ".join(words[start:end])).strip(" .,?;:")
        name = re.sub(r"['’]s?$", "", name).strip()
        if name and not _YEAR.fullmatch(name) and name.lower() not in QUESTION_WORDS and name not in out:
            out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def capital_phrases_of(c: pd.Series) -> pd.Series:
    return c.map(lambda q: None if q is None else capital_phrases(q))


# ---- calculator --------------------------------------------------------------------------------------------------

#: Longest expression, greatest exponent, most bits of a whole number.
MAX_CHARS, MAX_EXPONENT, MAX_BITS = 500, 10, 4096
_OPERATORS: dict[str, Callable] = {
    "Add": operator.add, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "Mod": operator.mod, "Pow": operator.pow, "USub": operator.neg, "UAdd": operator.pos,
}
_CALLS: dict[str, Callable] = {"sum": lambda *a: sum(a[0] if len(a) == 1 and isinstance(a[0], list) else a), "min": min, "max": max, "round": round, "abs": abs}


def calculate(expression: str) -> float:
    """Value of an arithmetic expression of numbers, + - * / % **, lists and sum, min, max, round, abs; ValueError for any other."""
    if not isinstance(expression, str) or not expression.strip() or len(expression) > MAX_CHARS:
        raise ValueError("empty or too long")
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError("no expression") from e

    def value(node: ast.AST):
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return v
            case ast.UnaryOp(op=op, operand=x) if type(op).__name__ in _OPERATORS:
                return _OPERATORS[type(op).__name__](value(x))
            case ast.List(elts=xs):
                return [value(x) for x in xs]
            case ast.Call(func=ast.Name(id=f), args=xs, keywords=[]) if f in _CALLS:
                return _CALLS[f](*map(value, xs))
            case ast.BinOp(left=a, op=op, right=b) if type(op).__name__ in _OPERATORS:
                x, y = value(a), value(b)
                if isinstance(op, ast.Pow) and (abs(y) > MAX_EXPONENT or (isinstance(x, int) and x.bit_length() * abs(y) > MAX_BITS)):
                    raise ValueError("too large")
                z = _OPERATORS[type(op).__name__](x, y)
                if isinstance(z, int) and z.bit_length() > MAX_BITS:
                    raise ValueError("too large")
                return z
        raise ValueError(f"not allowed: {type(node).__name__}")

    out = value(tree)
    if isinstance(out, bool) or not isinstance(out, (int, float)):
        raise ValueError("no number")
    return out


@F.pandas_udf(T.DoubleType())
def calculated(c: pd.Series) -> pd.Series:
    """calculate of a column; null where it raises."""
    def one(x):
        try:
            v = float(calculate(x))
            return v if math.isfinite(v) else None
        except (ValueError, ArithmeticError, TypeError, OverflowError, RecursionError):
            return None

    return pd.Series([one(x) for x in c], dtype="float64")


# ---- requests to language models ---------------------------------------------------------------------------------


def request_key(fields: dict[str, Column]) -> Column:
    """Key of a request: sha256 of its canonical JSON, fields sorted, without spaces."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def model_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost by prices per million tokens (in, out); unknown models cost 0."""
    out = F.lit(0.0)
    for name, (a, b) in prices.items():
        out = F.when(model == name, (tokens_in * a + tokens_out * b) / 1e6).otherwise(out)
    return out


def repaired_records(content: str, doc_id: str) -> list[dict]:
    """Records of a model's JSON with doc_id put into their evidence and a page label such as '[PAGE 45]' read as its number."""
    data = json.loads(content)
    records = data.get("records") if isinstance(data, dict) else None
    out = []
    for r in records or []:
        if isinstance(r, dict) and isinstance(r.get("evidence"), dict):
            e = {"doc_id": doc_id} | r["evidence"]
            digits = re.sub(r"\D", "", e["page"]) if isinstance(e.get("page"), str) else ""
            r = r | {"evidence": e | ({"page": int(digits)} if digits else {})}
        out.append(r)
    return out

"""Characters that scanning confuses, as Spark columns and as Python functions.

Fixed values, true form -> misread form: e c, a á, i !, i l, l 1, l I, o 0, t f, h b, g q, s 5, b 8, n ri, u ii,
m rn, d cl. fold() writes every confusable form in one way, the longest, so that a string and any of its misreadings
have the same fold whatever the number of misread characters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SINGLE = {"á": "a", "0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "8": "b", "h": "b", "q": "g", "e": "c", "f": "t"}
LONGER = {"m": "rri", "n": "ri", "u": "ii", "d": "ci"}
#: Single characters that no well-read word has.
ODD = "0158!|á"

_STEPS = list((SINGLE | LONGER).items())


def fold_text(s: str) -> str:
    """The fold of a string; no written form is a misread one, so that the steps may follow each other."""
    out = s.lower()
    for a, b in _STEPS:
        out = out.replace(a, b)
    return out


def fold(col: Column) -> Column:
    """The fold of a string column, in small letters."""
    out = F.translate(F.lower(col), "".join(SINGLE), "".join(SINGLE.values()))
    for a, b in LONGER.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out

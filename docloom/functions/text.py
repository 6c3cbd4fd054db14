"""Column expressions over texts that other operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed

#: The ASCII word boundary; Java's own is Unicode-aware.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A pattern with ASCII word boundaries, for Spark."""
    return pattern.replace(r"\b", _EDGE)


def java_lead(pattern: str) -> str:
    """java() for a pattern that starts with a word boundary and then a letter or digit: a look-behind is enough there."""
    return java(pattern.replace(r"(?i)\b", r"(?i)(?<![A-Za-z0-9_])", 1))


def alternatives(pattern: str) -> str:
    """The words, as patterns, one of which a pattern of the form (?i)\\bWORD... or (?i)\\b(?:WORD|WORD)... starts with."""
    found = re.match(r"\(\?i\)\\b(?:\(\?:([^)]*)\)|([A-Za-z0-9]+))", pattern)
    return found[1] or found[2]


def names(pattern: str) -> list[str]:
    """All spellings of these words, in upper case and without white space."""
    out = []
    for word in alternatives(pattern).split("|"):
        word = word.replace(r"\s*", "")
        out += [re.sub(r".\?", "", word).upper(), word.replace("?", "").upper()]
    return list(dict.fromkeys(out))


def rlike(col: Column, pattern: str) -> Column:
    return col.rlike(java(pattern))


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(java(pattern)))


def matches(col: Column, pattern: str) -> Column:
    """All whole matches of a pattern."""
    return F.regexp_extract_all(col, F.lit(java(pattern)), F.lit(0))


def words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: F.length(w) > 0)


def word_count(col: Column) -> Column:
    return F.size(words(col))


def trimmed(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalised(col: Column) -> Column:
    """Lower case, single spaces, no placeholders, dates as DATE."""
    out = F.regexp_replace(F.lower(col), r"\s+", " ")
    out = F.regexp_replace(out, r"\[.*?\]", "")
    return trimmed(F.regexp_replace(out, r"\d{1,2}/\d{1,2}/\d{2,4}", "DATE"))


def first_class(col: Column, classes: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that a text matches."""
    out = F.lit(other)
    for name, pattern in reversed(classes):
        out = F.when(rlike(col, f"(?i){pattern}"), name).otherwise(out)
    return out


def medical_terms(col: Column) -> Column:
    return sum((count(col, p) for p in fixed.MEDICAL_TERMS[1:]), count(col, fixed.MEDICAL_TERMS[0]))


def chunks(col: Column, size: int, overlap: int) -> Column:
    """Overlapping slices of a text; the last is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    n = F.length(col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.when(n <= size, F.array(col)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(col, i * step + 1, F.lit(size))))


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: White space beyond ASCII that the patterns' \\s has.
_WIDE = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def python(pattern: str) -> re.Pattern:
    """A pattern for Python: words and digits are ASCII, white space is not."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(two + _WIDE if inside else rf"[\s{_WIDE}]")
            at += 2
        elif two[0] == "\\":
            out.append(two)
            at += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at += 1
    return re.compile("".join(out), re.ASCII)


def number(col: Column) -> Column:
    """A number as it is written without needless decimals: 8.0 as 8."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def fixed_decimals(col: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", col.cast("double"))


def truncated(col: Column, most: int) -> Column:
    """A text of most characters; what is longer ends in three dots."""
    return F.when(F.length(col) <= most, col).otherwise(F.concat(F.left(col, F.lit(most - 3)), F.lit("...")))

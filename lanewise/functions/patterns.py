"""Text patterns: wildcards as Java regular expressions, and predicates over lines of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Case-insensitive, Unicode case, only \n ends a line.
FLAGS = "(?iud)"
_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?>|[*+?}]\+")


def wildcard(pattern: str, whole: bool) -> str:
    """`*` is any run within a line, `?` one character; the rest stands for itself. whole: the pattern spans the text."""
    parts = [".*" if c == "*" else "." if c == "?" else _quoted(c) for c in pattern]
    body = "".join(parts)
    return FLAGS + (rf"\A(?:{body})\z" if whole else body)


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c


def user_regex(pattern: str, case_sensitive: bool = False) -> str:
    """A user's regular expression for rlike; look-around, back references and possessive forms raise ValueError."""
    if _UNSUPPORTED.search(pattern.replace("\\\\", "")):
        raise ValueError(f"unsupported construct in {pattern!r}: look-around, back references and possessive quantifiers")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"invalid regular expression {pattern!r}") from e
    return f"({'?ud' if case_sensitive else '?iudU'}){pattern}"


def literal_regex(text: str, case_sensitive: bool = False) -> str:
    return ("(?d)" if case_sensitive else "(?iud)") + "".join(_quoted(c) for c in text)


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def name_matches(column: Column, pattern: str) -> Column:
    """Whole-name match without case. Names without wildcards compare by equality of lower case."""
    if pattern == "*":
        return F.lit(True)
    return column.rlike(wildcard(pattern, whole=True)) if has_wildcard(pattern) else F.lower(column) == pattern.lower()


def lines(column: Column) -> Column:
    r"""A text's lines: `\n` or `\r\n` ends a line, an empty last line doesn't count."""
    parts = F.split(F.coalesce(column, F.lit("")), r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def some_line(arrays: Column, regex: str) -> Column:
    return F.exists(arrays, lambda x: x.rlike(regex))


def first_line(column: Column) -> Column:
    return F.coalesce(F.get(lines(column), 0), F.lit(""))


def unescaped(column: Column) -> Column:
    r"""The two characters `\n` become a line break."""
    return F.replace(column, F.lit("\\n"), F.lit("\n"))

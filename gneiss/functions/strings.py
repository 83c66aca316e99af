"""Splitting, class tests and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def items(text: Column, separator: str = ",", protect: bool = True) -> Column:
    """Trimmed items between separators; with ``protect`` a separator inside parentheses or quotes does not count."""
    held = f"(?:[^{separator}\"(]|\"[^\"]*\"|\\([^)]*\\))+"
    parts = F.regexp_extract_all(text, F.lit(held), F.lit(0)) if protect else F.split(text, separator)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def number(text: Column, n: int = 1) -> Column:
    """The n-th number in a text, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(n - 1)).try_cast("double")


def alternation(text: Column) -> Column:
    """Runs of letters and runs of digits in their order."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{NUMBER}$"), F.lit(False))


def distance_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the length of ``a``."""
    return F.try_divide(F.levenshtein(a, b), F.length(a))


def among(value: Column, values: Column, mode: str = "equal") -> Column:
    """Whether ``value`` equals, begins (``prefix``) or lies in (``substring``) an item."""
    test = {"equal": lambda x: x == value, "prefix": lambda x: F.startswith(x, value), "substring": lambda x: F.contains(x, value)}[mode]
    return F.exists(values, test)


def close(a: Column, b: Column, tolerance: float, relative: bool = False) -> Column:
    return F.abs(a - b) <= (tolerance * F.greatest(F.abs(a), F.abs(b)) if relative else F.lit(tolerance))

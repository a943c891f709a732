"""Text expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def word_set(c: Column) -> Column:
    """Sorted distinct lower-case words, numbers left out."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))))


def sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def contains_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p.lower()))
    return found


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def by_difficulty(difficulty: Column, rule: Column, procedure: Column, exception: Column) -> Column:
    """Answer text: the rule; and its procedure; and its exception."""
    return (
        F.when(difficulty == "easy", rule)
        .when(difficulty == "normal", F.concat_ws(" ", rule, procedure))
        .otherwise(F.concat_ws(" ", rule, procedure, exception))
    )


def matching_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, which no built-in function has; null if either text is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in pairs], dtype="float64")

    return run(a, b)

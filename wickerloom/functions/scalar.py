"""Scalar functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DASHES = "‐‑‒–—―−"


@F.pandas_udf(T.StringType())
def normal_form(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, dashes as -, white space collapsed; Spark has no built-in for the first two."""
    table = str.maketrans(dict.fromkeys(_DASHES, "-"))
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(table).casefold().split()))


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rating_score(rating: Column) -> Column:
    """Rating out of 5, between 0 and 1; null counts 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(rating), F.lit(0.0)) / 5))


def count_score(n: Column) -> Column:
    """log(1 + n); null and negative count 0."""
    return F.log1p(F.greatest(F.lit(0), F.coalesce(n, F.lit(0))).cast("double"))


def clamp(score: Column) -> Column:
    """A cosine within -1 and 1; one that is further off than rounding explains fails."""
    return F.when(F.abs(score) <= 1.00001, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).otherwise(F.raise_error(F.concat(F.lit("no cosine: "), score.cast("string"))))


def pairwise_loss(positive: Column, negative: Column) -> Column:
    """-log sigmoid(positive - negative), without overflow."""
    d = positive - negative
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def first_occurrences(texts: Column) -> Column:
    """Entries without later ones that differ in case or outer blanks only; empty and null ones are left out."""
    # trim by name alone would take the entry's place for the characters to trim
    clean = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def redacted(text: Column) -> Column:
    """Keys, bearer tokens and home directories blacked out."""
    keys = F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*\S+", "$1=***")
    return F.regexp_replace(F.regexp_replace(keys, r"(?i)bearer\s+\S+", "Bearer ***"), r"(/home/|/Users/)[^/\s]+", "$1***")

"""Catalogue filters and inverted indices."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerloom.operators.text import TOKEN, category_form, contains_phrase, feature_tokens


def in_category(categories: Column, name: str) -> Column:
    """Whether a member equals the name in normal form; parts of a member don't count, and null is no member."""
    return F.coalesce(F.array_contains(F.transform(categories, category_form), F.lower(F.lit(" ".join(name.split())))), F.lit(False))


def _holds(phrase: list[str]):
    return lambda f: contains_phrase(feature_tokens(f), phrase)


def has_features(features: Column, wanted: Sequence[str]) -> Column:
    """Whether every wanted feature stands in one of the entries as a run of tokens; one without tokens is nowhere."""
    ok = F.lit(True)
    for w in wanted:
        phrase = re.findall(TOKEN, w.lower())
        ok = ok & (F.exists(F.filter(features, lambda f: f.isNotNull()), _holds(phrase)) if phrase else F.lit(False))
    return F.coalesce(ok, F.lit(False))


def within(column: str, least: float | None = None, most: float | None = None) -> Column:
    """Inclusive bounds; null and NaN are outside."""
    c = F.col(column)
    ok = c.isNotNull() & ~F.isnan(c)
    if least is not None:
        ok = ok & (c >= least)
    if most is not None:
        ok = ok & (c <= most)
    return F.coalesce(ok, F.lit(False))


def inverted_index(df: DataFrame, key: str, features: str) -> DataFrame:
    """(token, key) distinct: one row per token and listing, kept as rows so that a frequent token's list never is one value."""
    entries = df.select(key, F.explode(features).alias("f")).filter("f is not null")
    return entries.select(F.explode(feature_tokens(F.col("f"))).alias("token"), key).distinct()


def having_all_tokens(index: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Keys that stand in the lists of all tokens."""
    wanted = sorted(set(tokens))
    return index.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(key)


def categories_by_size(df: DataFrame, categories: str, least: int, top: int) -> DataFrame:
    """(category, n) of categories with at least so many rows, largest first, ties by name."""
    members = df.select(F.explode(F.array_distinct(F.transform(categories, category_form))).alias("category")).filter("category <> ''")
    return members.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "category").limit(top)

"""What a serving process loads and checks: the catalogue in canonical order, sorted lookups, aligned sets, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.operators.interactions import global_rank
from wickerloom.operators.text import clean_list, clean_text


def first_matches(df: DataFrame, targets: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The first n rows, by order, whose key is among the targets; each task keeps n."""
    return df.join(targets.select(key), key, "left_semi").orderBy(order).limit(n)


def checked_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df with the expected columns in their order; a missing column or another type fails with its name."""
    have = {f.name: f.dataType for f in df.schema}
    for f in expected:
        if have.get(f.name) != f.dataType:
            raise TypeError(f"{f.name} is {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}")
    return df.select(*expected.names)


def column_checks(df: DataFrame) -> DataFrame:
    """(column, n, n_null, least, most) of the integer columns, in one pass."""
    names = [f.name for f in df.schema]
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(c).cast("long").alias("least"), F.max(c).cast("long").alias("most")) for c in names]
    return df.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def valid_price(c: Column) -> Column:
    """A finite price above 0, else null."""
    return F.when(~F.isnan(c) & (c < float("inf")) & (c > 0), c)


def canonical_catalogue(catalogue: DataFrame, canonical: DataFrame) -> DataFrame:
    """(serving_row, item_index, parent_asin, title, price, categories, features) of the canonical items, rows from 0 in ascending item order.

    canonical: (item_index). An invalid or repeated item or parent, a missing item and an item beyond the canonical ones
    each fail: a catalogue that doesn't match is never served.
    """
    parent = F.trim("parent_asin")
    rows = catalogue.select("item_index", parent.alias("parent_asin"), F.nullif(clean_text(F.col("title")), F.lit("")).alias("title"), valid_price(F.col("price")).alias("price"), clean_list(F.col("categories")).alias("categories"), clean_list(F.col("features")).alias("features"))
    bad = rows.agg(F.count_if(F.col("item_index").isNull() | (F.col("item_index") < 0)).alias("items"), F.count_if(F.col("parent_asin").isNull() | (F.col("parent_asin") == "")).alias("parents")).first()
    if bad.items or bad.parents:
        raise ValueError(f"{bad['items']} invalid items and {bad.parents} invalid parents")
    for c in ("item_index", "parent_asin"):
        twice = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(c).first()
        if twice:
            raise ValueError(f"{c} {twice[0]} stands {twice['n']} times")
    wanted = canonical.select("item_index").distinct()
    for what, left, right in (("missing in the catalogue", wanted, rows), ("not canonical", rows, wanted)):
        off = left.join(right, "item_index", "left_anti").orderBy("item_index").first()
        if off:
            raise ValueError(f"item_index {off.item_index} is {what}")
    return global_rank(rows, "item_index", name="serving_row").withColumn("serving_row", F.col("serving_row") - 1)


def sorted_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """(position, key, value) in ascending order of the key's bytes, positions from 0; a repeated key fails."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(key).first()
    if twice:
        raise ValueError(f"{key} {twice[0]} stands {twice['n']} times")
    return global_rank(df.select(key, value), key, name="position").select((F.col("position") - 1).alias("position"), key, value)


def lookup_checks(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n, n_not_ascending (a key not above the one before it), whether positions and values are permutations of 0..n-1."""
    rows = lookup.select("position", key, value)
    before = rows.select((F.col("position") + 1).alias("position"), F.col(key).alias("__before"))
    n = F.count(F.lit(1))
    ordinal = lambda c: (F.count_distinct(c) == n) & (F.min(c) == 0) & (F.max(c) == n - 1)
    return rows.join(before, "position", "left").agg(n.alias("n"), F.count_if(F.col(key) <= F.col("__before")).alias("n_not_ascending"), ordinal("position").alias("positions_whole"), ordinal(value).alias("values_whole"))


def positional(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(position, first, second, same): rows of both sides at the same position, one side null where the other is longer."""
    left, right = a.select("position", F.col(key).alias("first")), b.select("position", F.col(key).alias("second"))
    return left.join(right, "position", "full_outer").select("position", "first", "second", F.col("first").eqNullSafe(F.col("second")).alias("same"))


def safe_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one JSON object; NaN and infinite numbers become null, as JSON has none."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        x = F.col(c)
        out.append((F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x).alias(c))
    return F.to_json(F.struct(*out), {"ignoreNullFields": "false"})


def ranking_guards(ranking: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row of what makes rankings unusable: cutoffs that aren't distinct and positive, repeated items, gaps in ranks, users without truth."""
    bad = len(ks) - len({k for k in ks if k > 0})
    users = ranking.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("i"), F.max("rank").alias("z"), F.count_distinct("rank").alias("r"))
    known = truth.select("user").distinct().withColumn("t", F.lit(True))
    return users.join(known, "user", "left").agg(
        F.lit(bad).alias("bad_cutoffs"), F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("i") < F.col("n")).alias("repeated_items"), F.count_if((F.col("z") != F.col("n")) | (F.col("r") < F.col("n"))).alias("broken_ranks"), F.count_if(F.col("t").isNull()).alias("without_truth")
    )


def report_lines(metrics: DataFrame) -> DataFrame:
    """(line) of a Markdown table with a row per k."""
    cell = lambda c: F.format_string("%.8f", c)
    return metrics.select(F.concat(F.lit("| Recall@"), F.col("k"), F.lit(" | "), cell("recall"), F.lit(" |")).alias("line")).unionByName(metrics.select(F.concat(F.lit("| NDCG@"), F.col("k"), F.lit(" | "), cell("ndcg"), F.lit(" |")).alias("line")))


def read_report(lines: DataFrame) -> DataFrame:
    """(metric, k, value) of the lines that are rows of a metrics table; other lines are passed over."""
    pattern = r"^\|\s*(\w+)@(\d+)\s*\|\s*([0-9]+(?:\.[0-9]+)?)\s*\|"
    part = lambda g: F.regexp_extract("line", pattern, g)
    return lines.filter(F.col("line").rlike(pattern)).select(part(1).alias("metric"), part(2).cast("int").alias("k"), part(3).cast("double").alias("value"))


def metric_deltas(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, k, value, baseline, delta, percent) of metrics that both sides have; percent is null over a baseline of 0."""
    both = metrics.join(baseline.withColumnRenamed("value", "baseline"), ["metric", "k"])
    delta = F.col("value") - F.col("baseline")
    return both.select("metric", "k", "value", "baseline", F.round(delta, 8).alias("delta"), F.when(F.col("baseline") != 0, F.round(100 * delta / F.col("baseline"), 4)).alias("percent"))

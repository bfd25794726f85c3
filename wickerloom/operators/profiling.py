"""Profiles of interactions, catalogues and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the degree buckets that hold more than one value, after 1 to 5; the last is open.
BUCKETS = ("1", "2", "3", "4", "5", "6-10", "11-20", "21-50", "51-100", ">100")


def totals(df: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of all rows per value; the total is summed over the few values, not over the rows again."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", F.round(F.col("n") / total, 6).alias("share"))


def degrees(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))


def degree_frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, degree, n): how many values of each key have each degree. Later statistics read only this small table."""
    out = None
    for k in keys:
        one = degrees(df.select(k), k).groupBy("degree").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "degree", "n")
        out = one if out is None else out.unionByName(one)
    return out


def degree_statistics(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("side").agg(
        F.sum("n").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("mean")
    )


def degree_percentiles(frequencies: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles with linear interpolation, exact, from weighted degrees."""
    p = F.expr(f"percentile(degree, array({', '.join(map(str, shares))}), n)")
    return frequencies.groupBy("side").agg(p.alias("p")).select("side", *(F.round(F.col("p")[i], 6).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)))


def bucket(degree: Column) -> Column:
    """Number of the bucket of BUCKETS, from 0."""
    return F.when(degree <= 5, degree - 1).when(degree <= 10, 5).when(degree <= 20, 6).when(degree <= 50, 7).when(degree <= 100, 8).otherwise(9).cast("int")


def degree_buckets(frequencies: DataFrame) -> DataFrame:
    """(side, bucket, label, n) with empty buckets kept."""
    spark = frequencies.sparkSession
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(BUCKETS)], "bucket int, label string")
    counts = frequencies.groupBy("side", bucket(F.col("degree")).alias("bucket")).agg(F.sum("n").alias("n"))
    every = frequencies.select("side").distinct().select("side", F.explode(F.sequence(F.lit(0), F.lit(len(BUCKETS) - 1))).alias("bucket"))
    return every.join(counts, ["side", "bucket"], "left").join(F.broadcast(labels), "bucket").select("side", "bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def is_available(df: DataFrame, column: str) -> Column:
    """Non-null, non-blank text, non-empty array."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if kind in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & ~F.isnan(c) if kind in ("double", "float") else c.isNotNull()


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, empty text or empty array; a text of blanks is not missing."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, available, missing, n_rows) of each column, in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.count_if(is_available(df, c)).alias(f"a_{c}") for c in columns), *(F.count_if(is_missing(df, c)).alias(f"m_{c}") for c in columns)
    )
    pairs = ", ".join(f"'{c}', a_{c}, m_{c}" for c in columns)
    return one.select("n_rows", F.expr(f"stack({len(columns)}, {pairs}) as (field, available, missing)")).select("field", "available", "missing", "n_rows")


def key_frequencies(df: DataFrame, json: str, top: int = 100) -> DataFrame:
    """The most frequent keys of a JSON column with their ratio to all rows; ties by key."""
    n = df.agg(F.count(F.lit(1))).scalar()
    keys = df.select(F.explode(F.json_object_keys(json)).alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("key", "n", F.round(F.col("n") / n, 6).alias("ratio")).orderBy(F.desc("n"), "key").limit(top)


def above_thresholds(df: DataFrame, length: Column, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, n_above, ratio), in one pass."""
    one = df.select(length.alias("l")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("l") > t).alias(f"t{t}") for t in thresholds))
    pairs = ", ".join(f"{t}, t{t}" for t in thresholds)
    return one.select("n", F.expr(f"stack({len(thresholds)}, {pairs}) as (threshold, n_above)")).select("threshold", "n_above", F.round(F.col("n_above") / F.col("n"), 6).alias("ratio"))


def ordered_fingerprint(df: DataFrame, index: str, line: Column, fan: int = 1000) -> DataFrame:
    """One row: SHA-256 over the rows in the order of their index, from 0 and unique, as a tree of `fan` entries a node.

    A node's text is bounded by fan, so no task holds all rows. An empty table has no fingerprint.
    """
    level = df.select(F.col(index).cast("long").alias("i"), line.alias("h"))
    top = df.agg(F.max(index)).first()[0] or 0
    depth = 1
    while top >= fan**depth:
        depth += 1
    for _ in range(depth):
        node = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda e: e["h"]), "")
        level = level.groupBy(F.floor(F.col("i") / fan).alias("i")).agg(F.sha2(node, 256).alias("h"))
    return level.select(F.col("h").alias("fingerprint"))

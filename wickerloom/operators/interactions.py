"""Interaction matrices: positives, latest events, k-core, temporal splits, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerloom.session import materialise


def positives(reviews: DataFrame, least: float = 4) -> DataFrame:
    """The latest positive event of each user and item; combined before the shuffle."""
    return reviews.filter(F.col("rating") >= least).groupBy("user", "item").agg(F.max("ts").alias("ts"))


def temporal_split(events: DataFrame) -> DataFrame:
    """events with split: of a user's events by (ts, item), the last is test, the one before valid, from three events on.

    events: distinct (user, item). Tasks send two events and a count of each user at most; the events themselves are
    matched with the chosen ones by user and item, so no user's history is one task's.
    """
    w = Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("item"))
    # Spark keeps two a user before the shuffle
    last = events.select("user", "item", "ts").withColumn("__back", F.row_number().over(w)).filter("__back <= 2").drop("ts")
    sizes = events.groupBy("user").agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 3")
    chosen = last.join(sizes, "user").select("user", "item", F.when(F.col("__back") == 1, "test").otherwise("valid").alias("split"))
    return events.join(chosen, ["user", "item"], "left").select(*events.columns, F.coalesce("split", F.lit("train")).alias("split"))


def kcore(df: DataFrame, k: int, user: str = "user", item: str = "item") -> DataFrame:
    """Rows whose user and item both keep at least k rows, repeated until nothing changes.

    A round drops users and then items with too few rows, which comes to the same core as dropping both at once but in
    fewer rounds; one that keeps all rows ends it. Null keys never qualify. Repeated rows count as rows. The lineage is
    cut in every round.
    """
    now = materialise(df.filter(F.col(user).isNotNull() & F.col(item).isNotNull()), "core")
    n = now.count()
    while True:
        users = now.groupBy(user).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(user)
        kept = now.join(users, user, "left_semi")
        items = kept.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(item)
        now = materialise(kept.join(items, item, "left_semi"), "core")
        before, n = n, now.count()
        if n == before:
            return now


def core_sizes(df: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n_users, n_items, n_rows) of each k-core; a larger core is computed within the smaller one."""
    out, now = None, df
    for k in sorted(ks):
        now = kcore(now, k)
        one = now.agg(F.lit(k).alias("k"), F.count_distinct("user").alias("n_users"), F.count_distinct("item").alias("n_items"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with its rows' places from 1 in the total order, without moving all rows into one task.

    Rows are range-partitioned and sorted; the partitions' sizes, one number each, give the offsets.
    """
    placed = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition, whatever the number of rows
    offsets = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__o") + place + 1).alias(name))


def history_offsets(df: DataFrame, user: str, item: str) -> DataFrame:
    """(user, n, start): distinct items of each user, and how many those before it in ascending order have together.

    Running sums are within partitions of the range-sorted users; one row per partition gives their starts.
    """
    counts = df.groupBy(user).agg(F.count_distinct(item).alias("n"))
    placed = materialise(counts.orderBy(user).withColumn("__p", F.spark_partition_id()), "offsets")
    within = F.sum("n").over(Window.partitionBy("__p").orderBy(user)) - F.col("n")
    starts = placed.groupBy("__p").agg(F.sum("n").alias("s")).select("__p", F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return placed.withColumn("__w", within).join(F.broadcast(starts), "__p").select(user, "n", (F.col("__w") + F.col("__o")).alias("start"))


def dense_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, dense_id): ids from 0 by the first place of each key; ties by key."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    return global_rank(first, "__first", key, name="dense_id").select(key, (F.col("dense_id") - 1).alias("dense_id"))


def encode(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with column's dense id; rows without one are left out."""
    return df.join(ids, column).drop(column)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only in a, only in b."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return x.join(y, key, "full_outer").agg(F.count_if(both).alias("in_both"), F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"))


def ordered_lookup(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(request, pos, key, row of table): the ids array of each request looked up in order, repeats kept; unknown ids give nulls."""
    return requests.select("request", F.posexplode("ids").alias("pos", key)).join(table, key, "left")

"""Popularity, recommendation lists and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerloom.operators.interactions import global_rank


def popularity(train: DataFrame) -> DataFrame:
    """(item, n, pop_rank) by rows, most first, ties by item."""
    counts = train.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counts, F.desc("n"), "item", name="pop_rank")


#: Ranks that are looked up in a broadcast table; the few beyond them by a join.
NEAR_RANKS = 65_536


def popularity_topk(train: DataFrame, users: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """(user, rank, item): each user's k most popular items without the ones in train.

    A user with s items seen needs the first k + s of the order at most, so only seen ranks up to there are kept and work
    is in the size of train plus k per user. The first ranks, which every user needs, are looked up in a table of bounded size.
    """
    n_items = pop.count()
    ranked = train.select("user", "item").distinct().join(pop.select("item", "pop_rank"), "item").select("user", "pop_rank")
    # a user's distinct items, at most the catalogue's size
    near = ranked.groupBy("user").agg(F.collect_list("pop_rank").alias("seen")).withColumn("s", F.size("seen")).withColumn("seen", F.filter("seen", lambda r: r <= k + F.col("s")))
    room = users.join(near, "user", "left").withColumn("last", F.least(F.lit(n_items), k + F.coalesce("s", F.lit(0))).cast("long"))
    ranks = F.when(F.col("last") > 0, F.sequence(F.lit(1).cast("long"), F.col("last"))).otherwise(F.array().cast("array<bigint>"))
    # array_except keeps the order
    first = F.slice(F.array_except(ranks, F.coalesce("seen", F.array().cast("array<bigint>"))), 1, k)
    top = room.select("user", F.posexplode(first).alias("place", "pop_rank"))
    names = pop.select("pop_rank", "item")
    head = top.filter(F.col("pop_rank") <= NEAR_RANKS).join(F.broadcast(names.filter(F.col("pop_rank") <= NEAR_RANKS)), "pop_rank")
    far = top.filter(F.col("pop_rank") > NEAR_RANKS).join(names.filter(F.col("pop_rank") > NEAR_RANKS), "pop_rank")
    return head.unionByName(far).select("user", (F.col("place") + 1).cast("long").alias("rank"), "item")


def popularity_target_ranks(train: DataFrame, targets: DataFrame, pop: DataFrame) -> DataFrame:
    """(user, item, rank): the place of a user's target among the items the user hasn't in train; 0 for one never seen in train.

    The place is the target's popularity rank less the user's seen items above it, so no list is built.
    """
    ranked = targets.join(pop.select("item", "pop_rank"), "item", "left").select("user", "item", F.col("pop_rank").alias("t"))
    seen = train.select("user", "item").distinct().join(pop.select("item", "pop_rank"), "item").select("user", F.col("pop_rank").alias("s"))
    joined = ranked.join(seen, "user", "left").groupBy("user", "item", "t").agg(F.count_if(F.col("s") < F.col("t")).alias("above"), F.count_if(F.col("s") == F.col("t")).alias("own"))
    return joined.select("user", "item", F.when(F.col("t").isNull() | (F.col("own") > 0), 0).otherwise(F.col("t") - F.col("above")).alias("rank"))


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _hit(rank: Column, k: int) -> Column:
    return (rank > 0) & (rank <= k)


def loo_metrics(ranks: DataFrame, ks: Sequence[int] = (10, 20, 50), by: str | None = None) -> DataFrame:
    """(k, n, recall, ndcg) of one target per user from its rank, 0 a miss; by: a column that parts the users."""
    r = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        aggs += [F.avg(F.when(_hit(r, k), 1.0).otherwise(0.0)).alias(f"r{k}"), F.avg(F.when(_hit(r, k), gain(r)).otherwise(0.0)).alias(f"g{k}")]
    one = (ranks.groupBy(by) if by else ranks).agg(*aggs)
    pairs = ", ".join(f"{k}, r{k}, g{k}" for k in ks)
    keep = [by] if by else []
    return one.select(*keep, "n", F.expr(f"stack({len(ks)}, {pairs}) as (k, recall, ndcg)")).select(*keep, "k", "n", F.round("recall", 8).alias("recall"), F.round("ndcg", 8).alias("ndcg"))


def mean_reciprocal_rank(ranks: DataFrame, k: int = 20) -> DataFrame:
    r = F.col("rank")
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(_hit(r, k), 1 / r).otherwise(0.0)), 8).alias("mrr"), F.count_if(~_hit(r, k)).alias("misses"))


def rank_metrics(ranking: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, n_users, recall, ndcg) with any number of relevant items per user, averaged over all users of truth.

    ranking: (user, rank, item) without repeats; truth: distinct (user, item). A user without a ranking counts 0.
    """
    hits = truth.join(ranking, ["user", "item"], "left").groupBy("user").agg(
        F.count(F.lit(1)).alias("m"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias(f"d{k}") for k in ks)
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("m").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    one = hits.agg(F.count(F.lit(1)).alias("n_users"), *(F.avg(F.col(f"h{k}") / F.col("m")).alias(f"r{k}") for k in ks), *(F.avg(F.col(f"d{k}") / ideal(k)).alias(f"g{k}") for k in ks))
    pairs = ", ".join(f"{k}, r{k}, g{k}" for k in ks)
    return one.select("n_users", F.expr(f"stack({len(ks)}, {pairs}) as (k, recall, ndcg)")).select("k", "n_users", F.round("recall", 8).alias("recall"), F.round("ndcg", 8).alias("ndcg"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps only k a group before the shuffle."""
    first = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
    return first.withColumn(name, F.col(name).cast("long"))


def min_max(value: Column, group: Sequence[str], constant: float) -> Column:
    """value scaled to 0..1 within the group; the constant where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(constant))


def z_scores(df: DataFrame, group: Sequence[str], value: str, name: str = "z", epsilon: float = 1e-6) -> DataFrame:
    """df with the value's z-score over the whole group, with the population's deviation; filter afterwards, not before.

    Moments are combined before the shuffle and joined, which Spark may split for a hot group.
    """
    moments = df.groupBy(*group).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__deviation"))
    return df.join(moments, list(group)).select(*df.columns, ((F.col(value) - F.col("__mean")) / (F.col("__deviation") + epsilon)).alias(name))

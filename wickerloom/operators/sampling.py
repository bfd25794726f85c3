"""Reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerloom.operators.ranking import top_per_group
from wickerloom.session import materialise


def hash_sample(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """n rows, of each group of by if given, in the order of a seeded hash of the key; the same rows on any cluster."""
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    marked = df.withColumn("__o", order)
    if by:
        return top_per_group(marked, by, [F.col("__o"), F.col(key)], n, "__r").drop("__o", "__r")
    return marked.orderBy("__o", key).limit(n).drop("__o")


def _drawn(*parts) -> Column:
    """60 bits of the parts' MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def negative_samples(positives: DataFrame, items: DataFrame, per_positive: int, seed: int, rounds: int = 100) -> DataFrame:
    """(user, item, draw, negative): items drawn evenly among those the user has no positive with, per_positive for each.

    items: (item, item_id) with item_id from 0 without gaps. Draws that hit a positive are drawn again, rounds times; those
    still left, of users with nearly every item, are drawn from the items that the user lacks. A user with every item has none.
    """
    n = items.count()
    known = positives.select("user", F.col("item").alias("negative")).distinct()
    todo = positives.select("user", "item", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))).alias("draw"))
    done = None
    for r in range(rounds):
        drawn = todo.withColumn("item_id", F.pmod(_drawn(F.lit(seed), "user", "item", "draw", F.lit(r)), F.lit(n)))
        named = materialise(drawn.join(items.select(F.col("item").alias("negative"), "item_id"), "item_id").select("user", "item", "draw", "negative"), "draws")
        good = named.join(known, ["user", "negative"], "left_anti").select("user", "item", "draw", "negative")
        done = good if done is None else done.unionByName(good)
        todo = named.join(known, ["user", "negative"], "left_semi").select("user", "item", "draw")
        if todo.isEmpty():
            return done
    return done.unionByName(_from_lacking(materialise(todo, "left"), known, items, seed))


def _from_lacking(todo: DataFrame, known: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """The draws of todo, even among the items that their users lack: todo's users by all items, less the known."""
    pairs = todo.select("user").distinct().crossJoin(items.select(F.col("item").alias("negative"))).join(known, ["user", "negative"], "left_anti")
    w = Window.partitionBy("user")
    lacking = materialise(pairs.withColumn("place", F.row_number().over(w.orderBy("negative"))).withColumn("n", F.count(F.lit(1)).over(w)), "lacking")
    sizes = lacking.select("user", "n").distinct()
    placed = todo.join(sizes, "user").withColumn("place", F.pmod(F.xxhash64("user", "item", "draw", F.lit(seed), F.lit("lacking")), F.col("n")) + 1)
    return placed.join(lacking.select("user", "place", "negative"), ["user", "place"]).select("user", "item", "draw", "negative")

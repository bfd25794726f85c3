"""Filling containers of fixed capacity by best-fit decreasing.

A task packs a bounded, evenly mixed share of the items; open containers are counted in the leaves of a segment tree by
their remaining capacity, so the tightest one that an item fits is found in logarithmic time. Containers that stay
loosely filled are then packed again as items among those of other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.session import materialise


class OpenContainers:
    """Open containers by remaining capacity: leaf r of the tree holds the stack of those with r left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, container: int, left: int) -> None:
        self.stacks[left].append(container)
        at = left + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least remaining capacity of at least size, and that capacity; it is taken out."""
        count, at = self.count, size + self.leaves
        while not count[at]:  # up to a subtree to the right that has one
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:  # down to its leftmost
            at = 2 * at if count[2 * at] else 2 * at + 1
        left = at - self.leaves
        container = self.stacks[left].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return container, left


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; sizes are from 1 to capacity."""
    tree, out, n = OpenContainers(capacity), np.empty(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        found = tree.take(size)
        if found is None:
            found, n = (n, capacity), n + 1
        out[k] = found[0]
        if found[1] > size:
            tree.put(found[0], found[1] - size)
    return out


def _pack_groups(items: DataFrame, capacity: int, group_items: int, salt: int, n_items: int) -> DataFrame:
    """items (unit, size) with container: numbers that are unique over all groups of this salt."""
    groups = max(1, -(-n_items // group_items))
    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = -1, []

        def packed() -> Iterator[pa.RecordBatch]:
            if held:
                unit, size = (np.concatenate(x) for x in zip(*held))
                # rows come by size and unit
                c = best_fit_decreasing(size, capacity)
                yield from pa.table({"unit": unit, "size": size, "container": (g << 32) | c}, pa.schema([("unit", pa.int64()), ("size", pa.int32()), ("container", pa.int64())])).to_batches()

        for b in batches:
            group, unit, size = (np.asarray(c) for c in b.columns)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for a, z in zip(starts, [*starts[1:], len(group)]):
                if int(group[a]) != g:
                    yield from packed()
                    g, held = int(group[a]), []
                held.append((unit[a:z], size[a:z]))
        yield from packed()

    # the hash mixes sizes and sources evenly over the groups; a task packs its groups one after the other and holds one at a time
    keyed = items.select(F.pmod(F.xxhash64("unit", F.lit(salt)), F.lit(groups)).alias("g"), "unit", "size")
    return keyed.repartition("g").sortWithinPartitions("g", F.desc("size"), "unit").mapInArrow(pack, schema)


def fill_containers(sizes: DataFrame, item: str, size: str, capacity: int, group_items: int = 25_000, loose: float = 0.98) -> DataFrame:
    """(item, piece, n_tokens, container): every item in one container of the capacity, as few as possible.

    Items larger than the capacity are the only ones split: pieces of the full capacity fill containers of their own,
    the rest is packed like an item. Items of size 0 or null get one row with size 0 and a null container.

    item must be unique. group_items bounds what a task packs at once, whatever the number of items. Containers filled below
    `loose` are packed again as wholes in groups mixed anew. Ties go to the smaller item number, so the result depends
    only on the rows, not on their order. An empty table gives an empty result.
    """
    cap = F.lit(capacity)
    base = sizes.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("n"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / cap)).cast("int")
    each = base.select("item", "n", F.posexplode(F.sequence(F.lit(1), n_pieces)).alias("piece", "_"))
    cut = materialise(each.select("item", F.col("piece").cast("int").alias("piece"), F.greatest(F.lit(0), F.least(cap, F.col("n") - F.col("piece") * cap)).cast("int").alias("n_tokens")), "pieces")
    # an item has at most one piece below the capacity, so item numbers identify those
    open_ = cut.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < cap)).select(F.col("item").alias("unit"), F.col("n_tokens").alias("size"))
    first = materialise(_pack_groups(open_, capacity, group_items, 1, open_.count()), "packed")
    filled = first.groupBy("container").agg(F.sum("size").cast("int").alias("size"))
    again = materialise(filled.filter(F.col("size") < F.lit(loose) * cap).select(F.col("container").alias("unit"), "size"), "loose")
    second = _pack_groups(again, capacity, group_items, 2, again.count()).select(F.col("unit").alias("container"), F.col("container").alias("merged"))
    placed = first.join(second, "container", "left").select(
        "unit", F.coalesce(F.concat(F.lit("m"), F.col("merged").cast("string")), F.concat(F.lit("c"), F.col("container").cast("string"))).alias("where")
    )
    full = cut.filter((F.col("n_tokens") == 0) | (F.col("n_tokens") == cap)).withColumn(
        "container", F.when(F.col("n_tokens") > 0, F.concat(F.lit("f"), F.col("item").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    )
    rest = cut.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < cap)).join(placed, F.col("item") == F.col("unit")).select("item", "piece", "n_tokens", F.col("where").alias("container"))
    return full.unionByName(rest).withColumnRenamed("item", item)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, their fill and the fewest containers that could hold the tokens."""
    each = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = F.sum("n")
    return each.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), (total / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(total / capacity).alias("least_possible"), F.max("n").alias("fullest"))

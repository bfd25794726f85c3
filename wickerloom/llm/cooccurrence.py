"""Items that appear together, counted as a blocked Gram matrix.

The records are the rows of a binary matrix X and the items its columns; the counts are the entries above the diagonal
of X'X. Tasks hold blocks of records as sorted sparse rows, multiply the columns of items that are popular in a block as
a matrix and the others sparsely, and sum the products before anything is shuffled, so what travels are block sums and
not the pairs of each record. Records wider than `wide` are cut into item blocks, and each
pair of item blocks is a task's work of its own, so no task holds a whole huge record or its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.session import materialise

#: Pair codes that a task holds before it sums them.
HELD_PAIRS = 4_000_000
#: Rows (record, item) of a block of records, and records of one matrix within it.
BLOCK_ROWS, MATRIX_ROWS = 200_000, 8192
#: An item is a column of the matrix if it is in one of so many of the block's records, and so many columns at most.
POPULAR, COLUMNS = 64, 512
PAIRS = T.StructType([T.StructField("item_a", T.LongType()), T.StructField("item_b", T.LongType()), T.StructField("n", T.LongType())])


class _Sums:
    """Sums of pairs (a, b), kept sorted and emptied when they outgrow the bound."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.held.append((a, b, np.ones(len(a), np.int64) if n is None else n))
            self.size += len(a)
            if self.size >= HELD_PAIRS:
                merged = self.merged()
                if len(merged[0]) > HELD_PAIRS // 2:
                    yield from self.batches(merged)
                    self.held, self.size = [], 0
                else:
                    self.held, self.size = [merged], len(merged[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate(x) for x in zip(*self.held))
        o = np.lexsort((b, a))
        a, b, n = a[o], b[o], n[o]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        starts = np.flatnonzero(new)
        return a[starts], b[starts], np.add.reduceat(n, starts)

    @staticmethod
    def batches(sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(sums[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in sums], ["item_a", "item_b", "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self.batches(self.merged())


def _product(record: np.ndarray, item: np.ndarray, sums: _Sums) -> Iterator[pa.RecordBatch]:
    """The transposed product of a block of records, whose rows are sorted by record and item.

    Items in many of the block's records are the columns of a binary matrix that is multiplied as a whole, so pairs of
    popular items are sums before they are pairs. The other pairs come diagonal by diagonal: neighbours at distance k.
    """
    row = np.cumsum(np.append(0, record[1:] != record[:-1]))
    items, at, n = np.unique(item, return_inverse=True, return_counts=True)
    popular = np.flatnonzero(n * POPULAR >= row[-1] + 1)
    if len(popular) > COLUMNS:
        popular = np.sort(popular[np.argsort(-n[popular], kind="stable")[:COLUMNS]])
    column = np.full(len(items), -1)
    column[popular] = np.arange(len(popular))
    column = column[at]
    dense = column >= 0
    if len(popular) > 1:
        gram = np.zeros((len(popular), len(popular)), np.int64)
        for first in range(0, row[-1] + 1, MATRIX_ROWS):
            here = dense & (row >= first) & (row < first + MATRIX_ROWS)
            x = np.zeros((min(MATRIX_ROWS, row[-1] + 1 - first), len(popular)), np.float32)
            x[row[here] - first, column[here]] = 1
            gram += (x.T @ x).astype(np.int64)  # below 2^24, so singles are exact
        p, q = np.nonzero(np.triu(gram, 1))
        yield from sums.add(items[popular[p]], items[popular[q]], gram[p, q])
    else:
        dense[:] = False
    left = np.arange(len(row))
    for k in range(1, len(row)):
        left = left[left + k < len(row)]
        left = left[row[left] == row[left + k]]  # a record that has no pair at k has none farther apart
        if not len(left):
            break
        some = left[~(dense[left] & dense[left + k])]
        yield from sums.add(item[some], item[some + k])


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block sums of rows (record, item) that are sorted by both; a record may run over batches, up to the wide limit."""
    sums, held, size = _Sums(), [], 0

    def block(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        record, item = (np.concatenate(x) for x in zip(*held))
        cut = len(record) if last else np.searchsorted(record, record[-1])
        if cut:
            yield from _product(record[:cut], item[:cut], sums)
        held, size = [(record[cut:], item[cut:])], len(record) - cut

    for b in batches:
        if b.num_rows:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield from block(False)
    if size:
        yield from block(True)
    yield from sums.rest()


def _block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of rows (left items, right items); an empty right stands for the left block with itself."""
    sums = _Sums()
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            x, y = np.asarray(left.values), np.asarray(right.values)
            # slices keep a product below the held bound whatever the blocks' width
            step = max(1, HELD_PAIRS // max(1, len(y) or len(x)))
            for k in range(0, len(x), step):
                a, b = np.repeat(x[k : k + step], len(y) or len(x)), np.tile(y if len(y) else x, len(x[k : k + step]))
                if not len(y):
                    keep = a < b
                    a, b = a[keep], b[keep]
                yield from sums.add(np.minimum(a, b), np.maximum(a, b))
    yield from sums.rest()


def cooccurrence(df: DataFrame, record: str, item: str, min_count: int = 1, wide: int = 2000, block: int = 1000) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_records, lift) of every pair of items, smaller first, in at least min_count records.

    n counts records with the item(s), lift is n_ab * n_records / (n_a * n_b). Items in fewer than min_count records are
    left out before the product, which loses no pair as no pair is more frequent than its items. Records that are null
    or negative aren't records; null items aren't items; repeated rows count once. Empty input, or no pair, gives no rows.
    wide: items from which a record is worked on by item blocks of about `block` items.
    """
    valid = df.select(F.col(record).cast("long").alias("r"), F.col(item).cast("long").alias("i")).filter("r >= 0")
    records = valid.agg(F.count_distinct("r").alias("n_records"))
    once = materialise(valid.filter("i is not null").distinct(), "baskets")
    n_records = F.lit(records.first().n_records).cast("long")
    items = materialise(once.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "items")
    kept = once.join(items, "i", "left_semi") if min_count > 1 else once
    sizes = kept.groupBy("r").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    broad = materialise(sizes.filter(F.col("m") > wide).select("r"), "wide")

    narrow = kept.join(broad, "r", "left_anti").select("r", "i").repartition("r").sortWithinPartitions("r", "i")
    partial = narrow.mapInArrow(_gram, PAIRS)
    if not broad.isEmpty():
        n_blocks = max(1, -(-items.count() // block))
        # the item block is part of the key, so a record with a third of all rows spreads over its blocks
        parts = kept.join(broad, "r", "left_semi").groupBy("r", F.pmod(F.xxhash64("i"), F.lit(n_blocks)).alias("b")).agg(F.sort_array(F.collect_list("i")).alias("x"))
        parts = materialise(parts, "blocks")
        same = parts.select(F.col("b").alias("bi"), F.col("b").alias("bj"), F.col("x").alias("left"), F.array().cast("array<bigint>").alias("right"))
        # each block goes to the pairs with every other block of its record, so a record's pairs are apart before they are made
        last = F.lit(n_blocks - 1)
        each = parts.select("r", "b", "x", F.explode(F.sequence(F.lit(0), last)).alias("o")).filter("o <> b")
        left = each.filter("b < o").select("r", F.col("b").alias("bi"), F.col("o").alias("bj"), F.col("x").alias("left"))
        right = each.filter("o < b").select("r", F.col("o").alias("bi"), F.col("b").alias("bj"), F.col("x").alias("right"))
        other = left.join(right, ["r", "bi", "bj"]).select("bi", "bj", "left", "right")
        products = same.unionByName(other).repartition("bi", "bj").select("left", "right").mapInArrow(_block_products, PAIRS)
        partial = partial.unionByName(products)
    pairs = partial.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    with_a = pairs.join(items.select(F.col("i").alias("item_a"), F.col("n").alias("n_a")), "item_a")
    both = with_a.join(items.select(F.col("i").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    kind = df.schema[item].dataType
    return both.select(
        F.col("item_a").cast(kind).alias("item_a"), F.col("item_b").cast(kind).alias("item_b"), "n_ab", "n_a", "n_b", n_records.alias("n_records"), (F.col("n_ab") * n_records / (F.col("n_a") * F.col("n_b"))).alias("lift")
    )


def associated(pairs: DataFrame, least_lift: int) -> DataFrame:
    """Pairs of cooccurrence with a lift of at least least_lift, compared without rounding."""
    exact = "cast(n_ab as decimal(38,0)) * n_records >= cast(n_a as decimal(38,0)) * n_b * " + str(int(least_lift))
    return pairs.filter(exact)

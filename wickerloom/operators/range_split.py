"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order) by Spark's sampled quantiles, so a heavy key spreads over as many
partitions as its share of the rows asks for. Every partition walks its sorted rows once in Arrow batches and leaves
one partial state per key; states of a key cut by a boundary are then stitched in partition order. A key has at most
one state per partition, so the last step never meets a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that the combiner holds before it emits partial rows.
COMBINE_ROWS = 1_000_000


@dataclass(frozen=True)
class Measure:
    """kind: rows, count, sum, min, max (of column), or distinct, max_gap, runs (of the first order column).

    sum, min and max take integer columns; nulls don't count. max_gap is the largest distance of neighbours in the
    order, null with fewer than two values; runs counts stretches without a distance above gap.
    """

    name: str
    kind: str
    column: str | None = None
    gap: int = 0


ALGEBRAIC = {"rows", "count", "sum", "min", "max"}


def _longs(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    valid = np.asarray(pc.is_valid(column))
    return np.asarray(pc.fill_null(pc.cast(column, pa.int64()), 0)), valid


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = np.asarray(pc.fill_null(pc.not_equal(a, b), False))
    return differs | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))


_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _walk(batches: Iterator[pa.RecordBatch], keys: Sequence[str], order: str | None, measures: Sequence[Measure], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId()
    carry: dict | None = None

    def batch_of(states: dict, n: int) -> pa.RecordBatch:
        arrays = []
        for field in schema:
            if field.name == "__pid":
                arrays.append(pa.array(np.full(n, pid), pa.int32()))
            else:
                x = states[field.name]
                arrays.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x[0], field.type, mask=~x[1]))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def piece(states: dict, a: int, b: int) -> dict:
        return {k: x.slice(a, b - a) if isinstance(x, pa.Array) else (x[0][a:b], x[1][a:b]) for k, x in states.items()}

    def merge(left: dict, states: dict) -> None:
        """Fold the carried state into the first of states."""
        touch = order is not None and left["__last"][1][0] and states["__first"][1][0]
        distance = int(states["__first"][0][0]) - int(left["__last"][0][0]) if touch else 0
        for m in measures:
            (x, ok), (y, there) = states[m.name], left[m.name]
            if m.kind in ("rows", "count", "sum"):
                x[0], ok[0] = x[0] + y[0], ok[0] | there[0]
            elif m.kind == "distinct":
                x[0] += y[0] - (touch and distance == 0)
            elif m.kind == "runs":
                x[0] += y[0] - (touch and distance <= m.gap)
            else:
                values = [v[0] for v, valid in ((x, ok), (y, there)) if valid[0]] + ([distance] if m.kind == "max_gap" and touch else [])
                if values:
                    x[0], ok[0] = (min if m.kind == "min" else max)(values), True
        if order is not None:
            for end in ("__first", "__last"):
                (x, ok), (y, there) = states[end], left[end]
                if there[0] and (end == "__first" or not ok[0]):
                    x[0], ok[0] = y[0], True

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= _changes(batch.column(batch.schema.get_field_index(k)))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n) - 1
        of = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
        always = np.ones(len(starts), bool)
        states: dict = {k: of(k).take(pa.array(starts)) for k in keys}
        if order is not None:
            v, valid = _longs(of(order))
            some = np.add.reduceat(valid.astype(np.int64), starts) > 0
            # nulls stand first in ascending order, so a segment's values are its tail
            first = ends - np.add.reduceat(valid.astype(np.int64), starts) + 1
            states["__first"] = (v[np.minimum(first, n - 1)].copy(), some.copy())
            states["__last"] = (v[ends].copy(), some.copy())
            inner = np.zeros(n, bool)  # rows with a valued neighbour before them in their segment
            inner[1:] = ~new[1:] & valid[1:] & valid[:-1]
            step = np.zeros(n, np.int64)
            step[1:] = np.where(inner[1:], v[1:] - v[:-1], 0)
        for m in measures:
            if m.kind == "rows":
                x = (np.add.reduceat(np.ones(n, np.int64), starts), always.copy()) if m.column is None else (np.add.reduceat(_longs(of(m.column))[0], starts), always.copy())
            elif m.kind in ("distinct", "runs"):
                apart = valid & (~inner | (step > m.gap if m.kind == "runs" else step != 0))
                x = (np.add.reduceat(apart.astype(np.int64), starts), always.copy())
            elif m.kind == "max_gap":
                x = (np.maximum.reduceat(step, starts), np.add.reduceat(inner.astype(np.int64), starts) > 0)
            else:
                c, there = _longs(of(m.column))
                any_ = np.add.reduceat(there.astype(np.int64), starts) > 0
                if m.kind == "count":
                    x = (np.add.reduceat(there.astype(np.int64), starts), always.copy())
                elif m.kind == "sum":
                    x = (np.add.reduceat(np.where(there, c, 0), starts), any_)
                else:
                    fill, f = (_HIGH, np.minimum) if m.kind == "min" else (_LOW, np.maximum)
                    x = (f.reduceat(np.where(there, c, fill), starts), any_)
            states[m.name] = x
        if carry is not None:
            if all(carry[k][0].as_py() == states[k][0].as_py() for k in keys):
                merge(carry, states)
            else:
                yield batch_of(carry, 1)
        m_ = len(starts)
        if m_ > 1:
            yield batch_of(piece(states, 0, m_ - 1), m_ - 1)
        carry = piece(states, m_ - 1, m_)
    if carry is not None:
        yield batch_of(carry, 1)


def _combine(batches: Iterator[pa.RecordBatch], keys: Sequence[str], measures: Sequence[Measure], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Partial rows (keys, block, measures) of bounded runs of input rows."""
    block = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        wanted = [([], "count_all") if m.kind == "rows" else (m.column, m.kind) for m in measures]
        g = t.group_by(list(keys)).aggregate(wanted)
        out = {k: g.column(k) for k in keys} | {"__block": pa.array(np.full(g.num_rows, block), pa.int64())}
        for m in measures:
            out[m.name] = g.column("count_all" if m.kind == "rows" else f"{m.column}_{m.kind}")
        yield from pa.table({f.name: out[f.name].cast(f.type) for f in schema}, schema=schema).to_batches()

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= COMBINE_ROWS:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def range_split_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], order: Sequence[str] = ()) -> DataFrame:
    """One row per key with the measures, exact, whatever share of the rows a key holds.

    order: integer secondary order; its first column is what distinct, max_gap and runs look at, the others only make
    heavy keys divisible. Without such measures and without order, rows are first combined within each input split and
    the split's number is the secondary order, so only partial rows are shuffled.

    Null keys form a group of their own; null order values don't count in distinct, max_gap and runs. Repeated rows
    count as often as they stand there; ties in the order are neighbours at distance 0. An empty input gives no rows.
    Only the named columns are read, so others with any names may be present.
    """
    ordered = [m for m in measures if m.kind not in ALGEBRAIC]
    if ordered and not order:
        raise ValueError("distinct, max_gap and runs need an order")
    keys, order, measures = list(keys), list(order), list(measures)
    needed = list(dict.fromkeys([*keys, *order, *(m.column for m in measures if m.column)]))
    rows = df.select(*needed)
    types = {f.name: f.dataType for f in rows.schema}
    if not order:
        partial = T.StructType([*(T.StructField(k, types[k]) for k in keys), T.StructField("__block", T.LongType()), *(T.StructField(m.name, T.LongType()) for m in measures)])
        arrow = _arrow_schema(partial)
        combined = list(measures)
        rows = rows.mapInArrow(lambda it: _combine(it, keys, combined, arrow), partial)
        order = ["__block"]
        measures = [Measure(m.name, {"count": "sum", "rows": "rows"}.get(m.kind, m.kind), m.name) for m in measures]
    state = T.StructType(
        [*(T.StructField(k, types[k]) for k in keys), T.StructField("__pid", T.IntegerType()), T.StructField("__first", T.LongType()), T.StructField("__last", T.LongType()), *(T.StructField(m.name, T.LongType()) for m in measures)]
    )
    arrow_state, steps, by = _arrow_schema(state), list(measures), order[0]
    split = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    states = split.mapInArrow(lambda it: _walk(it, keys, by, steps, arrow_state), state)
    if ordered:
        # last value seen before this state among the key's earlier states
        before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        states = states.withColumn("__distance", F.col("__first") - F.last("__last", ignorenulls=True).over(before))
    out = []
    for m in measures:
        c = F.col(m.name)
        if m.kind in ("rows", "sum", "count"):
            e = F.sum(c)
        elif m.kind in ("min", "max"):
            e = getattr(F, m.kind)(c)
        elif m.kind == "distinct":
            e = F.sum(c - F.when(F.col("__distance") == 0, 1).otherwise(0))
        elif m.kind == "runs":
            e = F.sum(c - F.when(F.col("__distance") <= m.gap, 1).otherwise(0))
        else:
            e = F.max(F.greatest(c, F.col("__distance")))
        out.append(e.alias(m.name))
    return states.groupBy(*keys).agg(*out)


def heavy_keys(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """(key_field, key_value, n_rows) of the values, neither null nor negative, that stand in at least share of all rows.

    Every row counts in the total, those without a value too. key_value has the columns' type, long where they differ. An
    empty table has no heavy keys.
    """
    kinds = {df.schema[c].dataType.simpleString() for c in columns}
    kind = kinds.pop() if len(kinds) == 1 else "bigint"
    names = ", ".join(f"'{c}', cast(`{c}` as {kind})" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {names}) as (key_field, key_value)")).filter("key_value >= 0")
    counts = range_split_aggregate(long, ["key_field", "key_value"], [Measure("n_rows", "rows")])
    # in decimals, so that a key with exactly the share is in
    return counts.filter(F.col("n_rows") >= F.lit(Decimal(str(share))) * df.agg(F.count(F.lit(1))).scalar())

"""Per-key results where a few keys hold most rows, against plain aggregation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wickerloom.operators.range_split import Measure, heavy_keys, range_split_aggregate

MEASURES = [Measure("n", "rows"), Measure("c", "count", "v"), Measure("s", "sum", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"), Measure("d", "distinct"), Measure("g", "max_gap"), Measure("r", "runs", gap=3)]
SCHEMA = "k int, o long, v long, n string, __pid string"


def plain(rows):
    out = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        v = [r[2] for r in own if r[2] is not None]
        o = sorted(r[1] for r in own if r[1] is not None)
        gaps = [b - a for a, b in zip(o, o[1:])]
        out.append((k, len(own), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), len(set(o)), max(gaps, default=None), len(o) - sum(g <= 3 for g in gaps)))
    return sorted(out, key=str)


def ours(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "extra", "clash") for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted((tuple(r) for r in range_split_aggregate(df, ["k"], MEASURES, ["o", "v"]).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_key_spans_all_partitions(spark):
    rows = [(7, i // 3, i % 5) for i in range(5000)] + [(8, 1, None), (None, None, None), (9, None, 2)]
    assert ours(spark, rows, 8) == plain(rows)


value = st.one_of(st.none(), st.integers(-5, 40))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from([1, 1, 1, 1, 2, 3, None]), value, value), max_size=60))
def test_any_rows(spark, rows):
    assert ours(spark, rows) == plain(rows)


def test_combined_before_the_shuffle(spark):
    df = spark.range(3000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    measures = [Measure("n", "rows"), Measure("c", "count", "v"), Measure("s", "sum", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v")]
    got = range_split_aggregate(df, ["k"], measures)
    want = df.groupBy("k").agg(F.count("*"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_text_keys_and_empty_input(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "k string, l string")
    assert sorted(map(str, range_split_aggregate(df, ["k", "l"], [Measure("n", "rows")]).collect())) == ["Row(k='a', l='x', n=2)", "Row(k=None, l='y', n=1)"]
    assert range_split_aggregate(df.filter("false"), ["k"], [Measure("n", "rows")]).collect() == []


def test_order_is_needed_for_ordered_measures(spark):
    with pytest.raises(ValueError):
        range_split_aggregate(spark.range(1), ["id"], [Measure("d", "distinct")])


def test_heavy_keys_count_every_row_in_the_total(spark):
    rows = [(1, 5)] * 10 + [(None, 6)] * 985 + [(-1, 7)] * 5
    df = spark.createDataFrame(rows, "a int, b int")
    got = {tuple(r) for r in heavy_keys(df, ["a", "b"], 0.01).collect()}
    assert got == {("a", 1, 10), ("b", 5, 10), ("b", 6, 985)}
    assert heavy_keys(df.filter("false"), ["a", "b"], 0.01).collect() == []


def test_heavy_keys_keep_the_type_of_their_column(spark):
    df = spark.createDataFrame([(1 << 40, 1)] * 3 + [(2, 2)], "a long, b int")
    assert sorted(map(tuple, heavy_keys(df, ["a"], 0.5).collect())) == [("a", 1 << 40, 3)]
    assert sorted(map(tuple, heavy_keys(df, ["a", "b"], 0.5).collect())) == [("a", 1 << 40, 3), ("b", 1, 3)]
    assert heavy_keys(df, ["b"], 0.5).schema["key_value"].dataType.simpleString() == "int"

"""Readers, writers, samples, scalar functions and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wickerloom.functions import scalar as S
from wickerloom.operators.sampling import hash_sample, negative_samples
from wickerloom.sources import io
from wickerloom.streaming.events import latest_per_user, read_events, windowed_counts


def test_json_lines_plain_and_gzipped(spark, tmp_path):
    row = {"user_id": "u", "parent_asin": "p", "rating": 4.0, "timestamp": 5}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps(row | {"user_id": "v"}) + "\n")
    got = io.read_json_lines(spark, str(tmp_path / "*.jsonl*"), io.REVIEW, 2)
    assert sorted(map(tuple, got.collect())) == [("u", "p", 4.0, 5), ("v", "p", 4.0, 5)]


def test_malformed_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user_id": "u", "rating": 1.0}\n{"user_id": \n{"user_id": "v", "rating": true}\n')
    assert [r.line for r in io.malformed_lines(spark, str(tmp_path), io.REVIEW).collect()] == ['{"user_id": ', '{"user_id": "v", "rating": true}']


def test_repeated_cases_fail_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("truth", T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]))])
    (tmp_path / "a.jsonl").write_text('{"case_id": "c1", "truth": {"ids": [1]}}\n')
    assert io.read_cases(spark, str(tmp_path / "a.jsonl"), schema).first().truth.ids == [1]
    (tmp_path / "b.jsonl").write_text('{"case_id": "c1"}\n{"case_id": "c1"}\n')
    with pytest.raises(ValueError, match="c1"):
        io.read_cases(spark, str(tmp_path / "b.jsonl"), schema)


def test_json_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"0": "raw a",\n "1": "raw b"}')
    assert sorted(map(tuple, io.read_json_map(spark, str(tmp_path / "m.json")).collect())) == [("0", "raw a"), ("1", "raw b")]


def test_publish_verifies_and_refuses(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path / "t")
    io.publish(df, path)
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(FileExistsError):
        io.publish(df, path)
    io.publish(df.limit(3), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_fingerprint_sees_changes_but_no_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert io.fingerprint(a).first() == io.fingerprint(a.orderBy(F.desc("i"))).first()
    assert io.fingerprint(a).first() != io.fingerprint(a.fillna("")).first()
    assert io.fingerprint(a.filter("false")).first().n_rows == 0


def test_fingerprint_sees_which_row_is_repeated(spark):
    one = lambda rows: io.fingerprint(spark.createDataFrame(rows, "i int, s string")).first()
    assert one([(1, "x")] * 2 + [(2, "y")] * 2 + [(9, "z")]) != one([(1, "x")] * 4 + [(9, "z")])
    assert one([(1, "x"), (1, "x"), (2, "y")]) != one([(1, "x"), (2, "y"), (2, "y")])


def test_publish_refuses_rows_that_change_on_the_way(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("k"), F.udf(lambda: __import__("random").random(), "double").asNondeterministic()().alias("u"))
    io.publish(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(OSError):
        io.publish(df, str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_encoding_resumes(spark, tmp_path):
    df, path = spark.range(20), str(tmp_path / "e")
    square = lambda d: d.select("id", (F.col("id") * F.col("id")).alias("x"))
    io.encode_resumably(df.filter("id < 7"), "id", square, path)
    got = io.encode_resumably(df, "id", square, path)
    assert sorted(map(tuple, got.collect())) == [(i, i * i) for i in range(20)]


def test_samples_repeat(spark):
    a = hash_sample(spark.range(500).repartition(7), "id", 20, 1)
    assert sorted(a.collect()) == sorted(hash_sample(spark.range(500), "id", 20, 1).collect()) != sorted(hash_sample(spark.range(500), "id", 20, 2).collect())


def test_negatives_are_no_positives(spark):
    pos = spark.createDataFrame([(u, i) for u in range(5) for i in range(8)], "user long, item long")
    items = spark.range(10).select(F.col("id").alias("item"), F.col("id").alias("item_id"))
    got = negative_samples(pos, items, 3, 1).collect()
    assert len(got) == 120 and {r.negative for r in got} <= {8, 9}


def test_draws_left_over_come_from_the_items_that_a_user_lacks(spark):
    pos = spark.createDataFrame([(1, i) for i in range(60) if i != 17] + [(2, 5)] + [(3, i) for i in range(60)], "user long, item long")
    items = spark.createDataFrame([(i, i) for i in range(60)], "item long, item_id long")
    got = [(r.user, r.item, r.draw, r.negative) for r in negative_samples(pos, items, 2, 1, rounds=1).collect()]
    assert len(got) == len({g[:3] for g in got}) == 2 * 59 + 2
    assert {n for u, _, _, n in got if u == 1} == {17} and all(n != 5 for u, _, _, n in got if u == 2)


@pytest.mark.parametrize("text, want", [("ＵＳＢ‑Ｃ  Straße", "usb-c strasse"), (None, None)])
def test_normal_form(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.normal_form("t")).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([(0.5, float("nan"), None, 3)], "a double, b double, c double, n int")
    got = df.select(S.finite(F.col("b")), S.rating_score(F.col("c")), S.clamp(F.col("a")), F.round(S.count_score(F.col("n")), 4), F.round(S.pairwise_loss(F.lit(2.0), F.lit(1.0)), 4), S.pairwise_loss(F.lit(-5000.0), F.lit(0.0))).first()
    assert tuple(got) == (None, 0.0, 0.5, 1.3863, 0.3133, 5000.0)
    assert df.select(S.redacted(F.lit("api_key=abc in /home/me/x"))).first()[0] == "api_key=*** in /home/***/x"
    assert df.select(S.first_occurrences(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("0b"), F.lit(None)))).first()[0] == ["A", "0b"]


def test_stream_and_batch_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        events.filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windowed_counts(read_events(spark, str(tmp_path / "in")), "1 hour", "3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = spark.sql("select window_start, event_type, n from counts")
        want = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).select("window_start", "event_type", "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        q.stop()
    assert latest_per_user(events.withColumn("ts", F.col("ts").cast("timestamp"))).count() == events.select("user_id").distinct().count()

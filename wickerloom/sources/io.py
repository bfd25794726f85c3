"""Readers and writers with fixed schemas, verified publication and resumable encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
METADATA = T.StructType(
    [T.StructField("parent_asin", T.StringType()), T.StructField("title", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("description", "features", "categories")]
    + [T.StructField("price", T.DoubleType()), T.StructField("store", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType())), T.StructField("average_rating", T.DoubleType()), T.StructField("rating_number", T.LongType())]
)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """Lines of JSON, plain or gzipped by suffix, under a fixed schema; a malformed line fails the read.

    One gzipped file is one task's work; partitions spreads its rows once for what follows.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.repartition(partitions) if partitions else df


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line) of the lines that don't parse under the schema."""
    marked = T.StructType([*schema, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.filter(F.trim("line") != "").withColumn("p", parsed).filter("p._corrupt is not null").select("file", "line")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that holds one flat JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two times 60 bits of each row's MD5 over its columns in order, with null apart from empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]
    whole = F.md5(F.concat_ws("\t", *parts))
    return tuple(F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows and sums of two hashes, which don't depend on the rows' order; every repetition of a row counts."""
    a, b = row_hashes(df)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return df.select(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), total("a").alias("hash_a"), total("b").alias("hash_b"))


def publish(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write beside the target, read back, compare fingerprints, then rename; an existing target is refused unless overwrite."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = jvm_path(path), jvm_path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    try:
        df.write.parquet(beside.toString())
        back = spark.read.schema(df.schema).parquet(beside.toString())
        want, got = fingerprint(df).first(), fingerprint(back).first()
        if want != got:
            raise OSError(f"{path} read back as {got}, not {want}")
        # the old table stays until the new one is in its place
        old = jvm_path(f"{path}.{uuid.uuid4().hex}.old")
        had = fs.exists(target) and fs.rename(target, old)
        if not fs.rename(beside, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{path} couldn't be put in place")
        if had:
            fs.delete(old, True)
    finally:
        if fs.exists(beside):
            fs.delete(beside, True)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, hash_a, hash_b, columns) of each table."""
    out = None
    for name, df in tables.items():
        one = fingerprint(df).select(F.lit(name).alias("name"), "*", F.lit(",".join(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def encode_resumably(source: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Append encode(rows) of the keys that path doesn't hold yet and return all of it; a second call adds nothing."""
    spark = source.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    left = source
    if fs.exists(target):
        left = source.join(spark.read.parquet(path).select(key), key, "left_anti")
    encode(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def read_cases(spark: SparkSession, path: str, schema: T.StructType, key: str = "case_id") -> DataFrame:
    """Evaluation cases from JSON lines under a nested schema; a missing or repeated key fails with its name."""
    cases = read_json_lines(spark, path, schema)
    bad = cases.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).orderBy(key).first()
    if bad:
        raise ValueError(f"{key} {bad[0]} stands {bad['n']} times in {path}" if bad[0] is not None else f"a case in {path} has no {key}")
    return cases

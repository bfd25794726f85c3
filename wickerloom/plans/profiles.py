"""Queries of §2.1-2.4: scans, predicates, profiles and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.operators import profiling as P
from wickerloom.plans.registry import Registry
from wickerloom.sources.tables import REVIEWS_SQL, reviews, table

PROFILES = Registry()
query = PROFILES.query
WITH = f"WITH {REVIEWS_SQL}"
DEGREES = f"""{WITH},
d AS (SELECT 'user' AS side, count(*) AS degree FROM reviews GROUP BY "user" UNION ALL SELECT 'item', count(*) FROM reviews GROUP BY item)
"""
FIELDS = ("title", "categories", "price", "average_rating", "rating_number", "features", "description", "store")


@query("src_07_enriched_ranges", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_indices IS NULL OR user_indices < 0) AS bad_user, count(*) FILTER (WHERE item_indices IS NULL OR item_indices < 0) AS bad_item,
       count(*) FILTER (WHERE ratings IS NULL OR isnan(ratings) OR NOT ratings BETWEEN 1 AND 5) AS bad_rating, count(*) FILTER (WHERE timestamps IS NULL OR timestamps < 0) AS bad_timestamp
FROM enriched_interactions""")  # fmt: skip
def enriched_ranges(spark, sf_dir):
    bad = lambda ok: F.count_if(~F.coalesce(F.expr(ok), F.lit(False)))
    return table(spark, sf_dir, "enriched_interactions").agg(
        F.count(F.lit(1)).alias("n_rows"), bad("user_indices >= 0").alias("bad_user"), bad("item_indices >= 0").alias("bad_item"), bad("ratings between 1 and 5 and not isnan(ratings)").alias("bad_rating"), bad("timestamps >= 0").alias("bad_timestamp")
    )


@query("src_03_first_of_targets", f"""{WITH}, t AS (SELECT DISTINCT item FROM reviews)
SELECT p_partkey, p_name FROM part SEMI JOIN t ON p_partkey = item""")  # fmt: skip
def first_of_targets(spark, sf_dir):
    targets = reviews(spark, sf_dir).select("item").distinct()
    return table(spark, sf_dir, "part").join(targets, F.col("p_partkey") == F.col("item"), "left_semi").select("p_partkey", "p_name")


@query("src_05_json_map", """
SELECT event_id, k.unnest AS key, json_extract_string(props, k.unnest) AS value FROM events, unnest(json_keys(props)) AS k""")  # fmt: skip
def json_map(spark, sf_dir):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(parsed).alias("key", "value"))


@query("agg_01_totals", f'{WITH} SELECT count(*) AS n_rows, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items FROM reviews')
def totals(spark, sf_dir):
    return P.totals(reviews(spark, sf_dir))


@query("agg_02_rating_histogram", f"{WITH} SELECT rating, count(*) AS n, round(count(*) / (SELECT count(*) FROM reviews), 6) AS share FROM reviews GROUP BY rating")
def rating_histogram(spark, sf_dir):
    return P.histogram(reviews(spark, sf_dir).select("rating"), "rating")


@query("agg_03_user_degrees", f'{WITH} SELECT "user", count(*) AS degree FROM reviews GROUP BY "user"')
def user_degrees(spark, sf_dir):
    return P.degrees(reviews(spark, sf_dir), "user")


@query("agg_03_item_degrees", f"{WITH} SELECT item, count(*) AS degree FROM reviews GROUP BY item")
def item_degrees(spark, sf_dir):
    return P.degrees(reviews(spark, sf_dir), "item")


def _frequencies(spark, sf_dir):
    return P.degree_frequencies(reviews(spark, sf_dir), ["user", "item"])


@query("agg_04_degree_statistics", DEGREES + "SELECT side, count(*) AS n, min(degree) AS least, max(degree) AS most, round(avg(degree), 6) AS mean FROM d GROUP BY side")
def degree_statistics(spark, sf_dir):
    return P.degree_statistics(_frequencies(spark, sf_dir))


@query("agg_05_degree_percentiles", DEGREES + "SELECT side, " + ", ".join(f"round(quantile_cont(degree, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM d GROUP BY side")
def degree_percentiles(spark, sf_dir):
    return P.degree_percentiles(_frequencies(spark, sf_dir))


@query("agg_06_degree_buckets", DEGREES + f"""
, b(bucket, label) AS (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(P.BUCKETS))})
SELECT s.side, b.bucket, b.label, count(degree) AS n FROM b CROSS JOIN (VALUES ('user'), ('item')) s(side)
LEFT JOIN d ON d.side = s.side AND bucket = CASE WHEN degree <= 5 THEN degree - 1 WHEN degree <= 10 THEN 5 WHEN degree <= 20 THEN 6 WHEN degree <= 50 THEN 7 WHEN degree <= 100 THEN 8 ELSE 9 END
GROUP BY ALL""")  # fmt: skip
def degree_buckets(spark, sf_dir):
    return P.degree_buckets(_frequencies(spark, sf_dir))


def _available_sql(c: str) -> str:
    return {"categories": "len(categories) > 0", "features": "len(features) > 0", "price": "NOT isnan(price)", "average_rating": "NOT isnan(average_rating)", "rating_number": "rating_number IS NOT NULL"}.get(c, f"trim({c}) <> ''")


def _missing_sql(c: str) -> str:
    return f"{c} IS NULL" + (f" OR len({c}) = 0" if c in ("categories", "features") else f" OR {c} = ''" if c in ("title", "description", "store") else "")


@query("agg_07_coverage", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE {_available_sql(c)}) AS available, count(*) FILTER (WHERE {_missing_sql(c)}) AS missing, count(*) AS n_rows FROM product_catalog" for c in FIELDS))
def coverage(spark, sf_dir):
    return P.coverage(table(spark, sf_dir, "product_catalog"), FIELDS)


@query("agg_08_key_frequencies", """
SELECT key, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS ratio FROM (SELECT unnest(json_keys(props)) AS key FROM events)
GROUP BY key ORDER BY n DESC, key LIMIT 100""")  # fmt: skip
def key_frequencies(spark, sf_dir):
    return P.key_frequencies(table(spark, sf_dir, "events"), "props")


@query("agg_09_length_thresholds", """
SELECT t AS threshold, count(*) FILTER (WHERE length(text) > t) AS n_above, round(count(*) FILTER (WHERE length(text) > t) / count(*), 6) AS ratio
FROM documents, (VALUES (512), (1024), (2048), (4096), (8192)) v(t) GROUP BY t""")  # fmt: skip
def length_thresholds(spark, sf_dir):
    return P.above_thresholds(table(spark, sf_dir, "documents"), F.length("text"), (512, 1024, 2048, 4096, 8192))


@query("agg_05_text_length_percentiles", """
SELECT source, count(*) AS n, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99, max(length(text)) AS longest
FROM documents WHERE text IS NOT NULL GROUP BY source""")  # fmt: skip
def text_length_percentiles(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").filter("text is not null").groupBy("source", F.length("text").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("source").agg(F.sum("n").alias("n"), F.round(F.expr("percentile(l, 0.5, n)"), 6).alias("p50"), F.round(F.expr("percentile(l, 0.99, n)"), 6).alias("p99"), F.max("l").cast("long").alias("longest"))


@query("agg_24_chunk_counts", "SELECT chunk_type, count(*) AS n, count(DISTINCT chunk_id) AS n_ids, count(DISTINCT item_index) AS n_items FROM chunks GROUP BY chunk_type")
def chunk_counts(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("n_ids"), F.count_distinct("item_index").alias("n_items"))


@query("agg_26_scan_statistics", f"{WITH} SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, min(rating) AS least, max(rating) AS most, round(avg(rating), 6) AS mean FROM reviews")
def scan_statistics(spark, sf_dir):
    return reviews(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("rating").alias("least"), F.max("rating").alias("most"), F.round(F.avg("rating"), 6).alias("mean"))


@query("agg_22_fingerprint", """
WITH l1 AS (SELECT item_index // 1000 AS b, sha256(string_agg(item_index || chr(9) || parent_asin || chr(10), '' ORDER BY item_index)) AS h FROM product_catalog GROUP BY 1)
SELECT CASE WHEN max(b) = 0 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS fingerprint FROM l1""")  # fmt: skip
def fingerprint(spark, sf_dir):
    line = F.concat(F.col("item_index").cast("string"), F.lit("\t"), "parent_asin", F.lit("\n"))
    return P.ordered_fingerprint(table(spark, sf_dir, "product_catalog"), "item_index", line)


@query("flt_11_length_bands", """
SELECT CASE WHEN n BETWEEN 256 AND 512 THEN 'short' WHEN n BETWEEN 800 AND 1200 THEN 'medium' WHEN n BETWEEN 1800 AND 2048 THEN 'long' END AS band, count(*) AS docs
FROM (SELECT n_chars AS n FROM documents) WHERE band IS NOT NULL GROUP BY band""")  # fmt: skip
def length_bands(spark, sf_dir):
    n = F.col("n_chars")
    band = F.when(n.between(256, 512), "short").when(n.between(800, 1200), "medium").when(n.between(1800, 2048), "long")
    return table(spark, sf_dir, "documents").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("docs")).filter("band is not null")


@query("sort_05_longest_documents", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 5")
def longest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5)


@query("date_01_iso_times", "SELECT interaction_id, strftime(make_timestamp(timestamps * 1000), '%Y-%m-%dT%H:%M:%S') AS iso FROM enriched_interactions WHERE timestamps BETWEEN 0 AND 4102444800000")
def iso_times(spark, sf_dir):
    rows = table(spark, sf_dir, "enriched_interactions").filter("timestamps between 0 and 4102444800000")
    return rows.select("interaction_id", F.date_format(F.timestamp_millis("timestamps"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("math_02_log_popularity", f"{WITH} SELECT item, round(ln(1 + count(*)), 6) AS weight FROM reviews GROUP BY item")
def log_popularity(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("item").agg(F.round(F.log1p(F.count(F.lit(1))), 6).alias("weight"))

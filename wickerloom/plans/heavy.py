"""Queries p1: per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.operators.range_split import Measure, heavy_keys, range_split_aggregate
from wickerloom.plans.registry import Registry
from wickerloom.sources.tables import table

HEAVY = Registry()
SHARE = 0.01
SESSION_GAP_MS = 30 * 86_400_000


@HEAVY.query(
    "p1_found",
    """
SELECT key_field, key_value FROM (
  SELECT 'item_indices' AS key_field, item_indices AS key_value, count(*) AS n FROM enriched_interactions GROUP BY ALL
  UNION ALL SELECT 'user_indices', user_indices, count(*) FROM enriched_interactions GROUP BY ALL)
WHERE key_value >= 0 AND n * 100 >= (SELECT count(*) FROM enriched_interactions)
""",
)
def p1_found(spark, sf_dir):
    return heavy_keys(table(spark, sf_dir, "enriched_interactions"), ["item_indices", "user_indices"], SHARE).select("key_field", "key_value")


def _profile(spark, sf_dir, key, other):
    rows = table(spark, sf_dir, "enriched_interactions").filter(F.col(key) >= 0).select(key, other, "interaction_id", "timestamps", F.when(F.col("ratings").between(1, 5), F.col("ratings").cast("long")).alias("rating"))
    measures = [
        Measure("n_rows", "rows"), Measure("n_partners", "distinct"), Measure("n_rated", "count", "rating"), Measure("rating_sum", "sum", "rating"),
        Measure("first_ts", "min", "timestamps"), Measure("last_ts", "max", "timestamps"),
    ]
    return range_split_aggregate(rows, [key], measures, [other, "interaction_id"])


_PROFILE_SQL = """
SELECT {key}, count(*) AS n_rows, count(DISTINCT {other}) AS n_partners, count(*) FILTER (WHERE ratings BETWEEN 1 AND 5) AS n_rated,
       CAST(sum(CASE WHEN ratings BETWEEN 1 AND 5 THEN CAST(trunc(ratings) AS BIGINT) END) AS BIGINT) AS rating_sum,
       min(timestamps) AS first_ts, max(timestamps) AS last_ts
FROM enriched_interactions WHERE {key} >= 0 GROUP BY {key}
"""


@HEAVY.query("p1_item_profile", _PROFILE_SQL.format(key="item_indices", other="user_indices"))
def p1_item_profile(spark, sf_dir):
    return _profile(spark, sf_dir, "item_indices", "user_indices")


@HEAVY.query("p1_user_profile", _PROFILE_SQL.format(key="user_indices", other="item_indices"))
def p1_user_profile(spark, sf_dir):
    return _profile(spark, sf_dir, "user_indices", "item_indices")


@HEAVY.query(
    "p1_item_activity",
    f"""
WITH d AS (
  SELECT item_indices, timestamps, timestamps - lag(timestamps) OVER (PARTITION BY item_indices ORDER BY timestamps) AS gap
  FROM enriched_interactions WHERE item_indices >= 0 AND timestamps > 0)
SELECT item_indices, count(*) AS n_rows, max(gap) AS longest_gap_ms,
       count(*) - count(*) FILTER (WHERE gap <= {SESSION_GAP_MS}) AS n_sessions FROM d GROUP BY item_indices
""",
)
def p1_item_activity(spark, sf_dir):
    rows = table(spark, sf_dir, "enriched_interactions").filter("item_indices >= 0 and timestamps > 0")
    measures = [Measure("n_rows", "rows"), Measure("longest_gap_ms", "max_gap"), Measure("n_sessions", "runs", gap=SESSION_GAP_MS)]
    return range_split_aggregate(rows, ["item_indices"], measures, ["timestamps", "interaction_id"])

"""Queries p2 to p8 over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.llm import cooccurrence as pairs
from wickerloom.llm.matching import group_pairs, product_groups
from wickerloom.llm.mixing import mix
from wickerloom.llm.packing import container_report, fill_containers
from wickerloom.llm.residue import find_residue
from wickerloom.llm.splitting import catalogue_chunks
from wickerloom.llm.survivors import interaction_survivors
from wickerloom.llm.tokens import count_tokens
from wickerloom.session import materialise

QUERIES: dict = {}
ORACLES: dict = {}
CAPACITY = 2048
LEAST_BASKETS, LEAST_LIFT = 10, 3


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("p2_found")
def p2_found(spark, sf_dir):
    return group_pairs(product_groups(_read(spark, sf_dir, "product_catalog")))


@query("p2_groups")
def p2_groups(spark, sf_dir):
    return product_groups(_read(spark, sf_dir, "product_catalog"))


_PAIRS_SQL = f"""
WITH t AS (SELECT DISTINCT user_indices AS u, item_indices AS i FROM train WHERE user_indices >= 0 AND item_indices IS NOT NULL),
s AS (SELECT i, count(*) AS n FROM t GROUP BY i),
k AS (SELECT u, i FROM t JOIN s USING (i) WHERE n >= {LEAST_BASKETS}),
p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n_ab FROM k a JOIN k b ON a.u = b.u AND a.i < b.i GROUP BY ALL HAVING count(*) >= {LEAST_BASKETS}),
q AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT user_indices) FROM train WHERE user_indices >= 0) AS n_records
      FROM p JOIN s x ON x.i = item_a JOIN s y ON y.i = item_b)
"""


@query("p3_found", _PAIRS_SQL + f"SELECT item_a, item_b FROM q WHERE n_ab * n_records >= {LEAST_LIFT} * n_a * n_b")
def p3_found(spark, sf_dir):
    counted = pairs.cooccurrence(_read(spark, sf_dir, "train"), "user_indices", "item_indices", LEAST_BASKETS)
    return pairs.associated(counted, LEAST_LIFT).select("item_a", "item_b")


@query("p3_pairs", _PAIRS_SQL + "SELECT item_a, item_b, n_ab, n_a, n_b, n_records, round(n_ab * n_records / (n_a * n_b), 6) AS lift FROM q")
def p3_pairs(spark, sf_dir):
    return pairs.cooccurrence(_read(spark, sf_dir, "train"), "user_indices", "item_indices", LEAST_BASKETS).withColumn("lift", F.round("lift", 6))


@query("p3_all_pairs", """
WITH t AS (SELECT DISTINCT user_indices AS u, item_indices AS i FROM train WHERE user_indices >= 0 AND item_indices IS NOT NULL),
s AS (SELECT i, count(*) AS n FROM t GROUP BY i),
p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n_ab FROM t a JOIN t b ON a.u = b.u AND a.i < b.i GROUP BY ALL),
q AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT user_indices) FROM train WHERE user_indices >= 0) AS n_records
      FROM p JOIN s x ON x.i = item_a JOIN s y ON y.i = item_b)
SELECT item_a, item_b, n_ab, n_a, n_b, n_records, n_ab * n_records / (n_a * n_b) AS lift FROM q""")
def p3_all_pairs(spark, sf_dir):
    """The count and lift of every pair that occurs; p3_pairs is its part of LEAST_BASKETS and more."""
    return pairs.cooccurrence(_read(spark, sf_dir, "train"), "user_indices", "item_indices")


_SURVIVORS_SQL = """
WITH r AS (
  SELECT e.user_indices, e.item_indices, e.interaction_id, e.ratings, e.timestamps, coalesce(f.trust, -1) AS trust, e.ingested_at,
         e.ratings BETWEEN 1 AND 5 AS rating_ok,
         e.timestamps >= 946684800000 AND e.timestamps * 1000 <= epoch_us(e.ingested_at) AS time_ok
  FROM enriched_interactions e LEFT JOIN feeds f ON lower(trim(e.feed)) = lower(trim(f.feed))
  WHERE e.user_indices >= 0 AND e.item_indices >= 0)
SELECT user_indices, item_indices,
       arg_max(interaction_id, {'a': trust, 'b': ingested_at, 'c': interaction_id}) FILTER (WHERE rating_ok) AS rating_from,
       arg_max(interaction_id, {'a': trust, 'b': ingested_at, 'c': interaction_id}) FILTER (WHERE time_ok) AS timestamp_from
FROM r GROUP BY ALL HAVING count(*) >= 2
"""


def _survivors(spark, sf_dir, **options):
    return interaction_survivors(_read(spark, sf_dir, "enriched_interactions"), _read(spark, sf_dir, "feeds"), **options)


@query("p4_found", _SURVIVORS_SQL)
def p4_found(spark, sf_dir):
    return _survivors(spark, sf_dir)[0].select("user_indices", "item_indices", "rating_from", "timestamp_from")


@query("p4_records", _SURVIVORS_SQL.replace("SELECT user_indices, item_indices,\n", "SELECT user_indices, item_indices, count(*) AS n_rows,\n       arg_max(ratings, {'a': trust, 'b': ingested_at, 'c': interaction_id}) FILTER (WHERE rating_ok) AS rating,\n       arg_max(timestamps, {'a': trust, 'b': ingested_at, 'c': interaction_id}) FILTER (WHERE time_ok) AS timestamp,\n").replace(" HAVING count(*) >= 2", ""))
def p4_records(spark, sf_dir):
    """One record for every user and item, those with a single row too."""
    return _survivors(spark, sf_dir, least_rows=1)[0].select("user_indices", "item_indices", "n_rows", "rating", "timestamp", "rating_from", "timestamp_from")


@query("p4_consensus")
def p4_consensus(spark, sf_dir):
    return _survivors(spark, sf_dir, strict=False)[0]


@query("p4_reliability")
def p4_reliability(spark, sf_dir):
    return _survivors(spark, sf_dir, strict=False)[1]


_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"


@query("p5_found", f"""
WITH t AS (SELECT item_index, 'description' AS chunk_type, description AS t FROM product_catalog
  UNION ALL SELECT item_index, 'features', array_to_string(list_filter(features, lambda x: x IS NOT NULL), chr(10)) FROM product_catalog)
SELECT item_index, chunk_type FROM t WHERE length(trim(regexp_replace(t, '{_SPACE}', ' ', 'g'))) > 1600""")  # fmt: skip
def p5_found(spark, sf_dir):
    # a text over the limit is one that has a second piece
    return catalogue_chunks(_read(spark, sf_dir, "product_catalog")).filter("part_index = 1").select("item_index", "chunk_type")


@query("p5_chunks")
def p5_chunks(spark, sf_dir):
    return catalogue_chunks(_read(spark, sf_dir, "product_catalog"))


def _sizes(spark, sf_dir):
    return materialise(count_tokens(_read(spark, sf_dir, "documents"), ["doc_id", "source"]), "sizes")


@query("p6_pack")
def p6_pack(spark, sf_dir):
    return fill_containers(_sizes(spark, sf_dir), "doc_id", "n_tokens", CAPACITY)


@query("p6_report")
def p6_report(spark, sf_dir):
    return container_report(p6_pack(spark, sf_dir), CAPACITY)


@query("p7_mix")
def p7_mix(spark, sf_dir):
    return mix(_sizes(spark, sf_dir), _read(spark, sf_dir, "mix_targets"))[0]


@query("p7_shares")
def p7_shares(spark, sf_dir):
    return mix(_sizes(spark, sf_dir), _read(spark, sf_dir, "mix_targets"))[1]


@query("p8_found")
def p8_found(spark, sf_dir):
    return find_residue(_read(spark, sf_dir, "documents")).filter("label is not null").select("doc_id")


@query("p8_named")
def p8_named(spark, sf_dir):
    return find_residue(_read(spark, sf_dir, "documents")).filter("label is not null")


@query("p8_clean")
def p8_clean(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents")
    return documents.join(find_residue(documents).filter("label is null").select("doc_id"), "doc_id")

"""Queries of §2.1-2.8 on joins, projections, sinks, sampling, scalar functions and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.functions import scalar as S
from wickerloom.operators import interactions as I
from wickerloom.operators import ranking as R
from wickerloom.operators import text as X
from wickerloom.operators.sampling import hash_sample, negative_samples
from wickerloom.plans.registry import Registry
from wickerloom.plans.splits import POP
from wickerloom.plans.texts import _list, sql_clean
from wickerloom.plans.vectors import EVERY, TOPK
from wickerloom.session import materialise, shared_dir
from wickerloom.sources import io
from wickerloom.sources.tables import REVIEWS_SQL, reviews, table
from wickerloom.streaming.events import read_table_stream, run_once, windowed_counts

MORE = Registry()
query = MORE.query


@query("snk_01_json_round_trip", "SELECT interaction_id, user_indices, item_indices, feed FROM enriched_interactions")
def json_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "enriched_interactions").select("interaction_id", "user_indices", "item_indices", "feed")
    path = f"{shared_dir(spark)}/wickerloom/json-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").json(path)
    return io.read_json_lines(spark, path, rows.schema)


@query("snk_03_publish", "SELECT user_indices, item_indices FROM train")
def publish(spark, sf_dir):
    path = f"{shared_dir(spark)}/wickerloom/published-{uuid.uuid4().hex}"
    io.publish(table(spark, sf_dir, "train"), path)
    return spark.read.parquet(path)


def _fingerprint_sql(name: str, columns: list[str]) -> str:
    line = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns)
    return f"SELECT '{name}' AS name, count(*) AS n_rows, CAST(coalesce(sum(a), 0) AS VARCHAR) AS hash_a, CAST(coalesce(sum(b), 0) AS VARCHAR) AS hash_b, '{','.join(columns)}' AS columns FROM (SELECT CAST('0x' || substr(h, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b FROM (SELECT md5(concat_ws(chr(9), {line})) AS h FROM {name}))"


#: Tables of the manifest with the columns whose text form both engines share.
_MANIFEST = {
    "train": ["user_indices", "item_indices"], "feeds": ["feed", "trust"], "chunks": ["chunk_id", "chunk_index", "item_index", "parent_asin", "chunk_type", "part_index", "text"], "documents": ["doc_id", "text", "lang", "source", "n_chars", "item_index"],
    "product_catalog": ["item_index", "parent_asin", "title", "rating_number", "description", "store"], "enriched_interactions": ["interaction_id", "user_indices", "item_indices", "timestamps", "feed"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


@query("snk_06_manifest", " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in _MANIFEST.items()))
def manifest(spark, sf_dir):
    return io.manifest({n: table(spark, sf_dir, n).select(*c) for n, c in _MANIFEST.items()})


@query("snk_05_resumable_encoding", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def resumable_encoding(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    path = f"{shared_dir(spark)}/wickerloom/encoded-{uuid.uuid4().hex}"
    sizes = lambda df: df.select("doc_id", F.length("text").cast("long").alias("n"))
    # a first run that was cut short, then one that finishes
    io.encode_resumably(texts.filter("doc_id < 100"), "doc_id", sizes, path)
    return io.encode_resumably(texts, "doc_id", sizes, path)


#: Fields of a comparison: name and SQL, which both engines share.
COMPARED = {"title": "title", "store": "store", "rating_number": "CAST(rating_number AS STRING)", "parent_asin": "parent_asin", "n_categories": "CAST(len(categories) AS STRING)"}


@query("prj_05_comparison", f"""
WITH q AS (SELECT DISTINCT user_indices AS request, item_indices AS item_index FROM train WHERE user_indices >= 0 AND item_indices IS NOT NULL),
f AS (SELECT item_index, unnest([{", ".join(f"'{n}'" for n in COMPARED)}]) AS field, unnest([{", ".join(COMPARED.values())}]) AS value FROM product_catalog)
SELECT request, field, string_agg(coalesce(value, '-'), ' | ' ORDER BY item_index) AS products FROM q JOIN f USING (item_index) GROUP BY request, field""")  # fmt: skip
def comparison(spark, sf_dir):
    """A row per request and field with the values of all its products, in item order."""
    asked = table(spark, sf_dir, "train").filter("user_indices >= 0 and item_indices is not null").select(F.col("user_indices").alias("request"), F.col("item_indices").alias("item_index")).distinct()
    values = F.array(*(F.struct(F.lit(n).alias("field"), F.expr(e.replace("len(", "size(")).alias("value")) for n, e in COMPARED.items()))
    products = asked.join(table(spark, sf_dir, "product_catalog").select("item_index", values.alias("f")), "item_index").select("request", "item_index", F.explode("f").alias("f"))
    # a request's products are as many as its basket holds
    listed = F.transform(F.array_sort(F.collect_list(F.struct("item_index", F.coalesce("f.value", F.lit("-")).alias("v")))), lambda x: x["v"])
    return products.groupBy("request", "f.field").agg(F.array_join(listed, " | ").alias("products"))


@query("prj_06_finite_numbers", "SELECT item_index, CASE WHEN isfinite(price) AND price > 0 THEN price END AS price FROM product_catalog")
def finite_numbers(spark, sf_dir):
    p = S.finite(F.col("price"))
    return table(spark, sf_dir, "product_catalog").select("item_index", F.when(p > 0, p).alias("price"))


@query("join_11_identity_status", """
WITH a AS (SELECT DISTINCT user_indices AS u FROM enriched_interactions WHERE user_indices IS NOT NULL), t AS (SELECT DISTINCT user_indices AS u FROM train WHERE user_indices >= 0), b AS (SELECT DISTINCT user_id AS u FROM events)
SELECT a.u AS "user", CASE WHEN t.u IS NOT NULL THEN 'trained' WHEN b.u IS NOT NULL THEN 'seen' ELSE 'unknown' END AS status FROM a LEFT JOIN t USING (u) LEFT JOIN b ON b.u = a.u""")  # fmt: skip
def identity_status(spark, sf_dir):
    users = table(spark, sf_dir, "enriched_interactions").filter("user_indices is not null").select(F.col("user_indices").alias("user")).distinct()
    trained = table(spark, sf_dir, "train").filter("user_indices >= 0").select(F.col("user_indices").alias("user")).distinct().withColumn("t", F.lit(True))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("user")).distinct().withColumn("s", F.lit(True))
    return users.join(trained, "user", "left").join(seen, "user", "left").select("user", F.when(F.col("t"), "trained").when(F.col("s"), "seen").otherwise("unknown").alias("status"))


@query("join_12_target_in_list", TOPK.format("") + """
SELECT q.query_id, coalesce(t.rank, 0) AS rank FROM (SELECT DISTINCT query_id FROM s) q LEFT JOIN r t ON t.query_id = q.query_id AND t.vec_id = q.query_id + 1 AND t.rank <= 10""")  # fmt: skip
def target_in_list(spark, sf_dir):
    from wickerloom.operators.vectors import vector_topk

    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_topk(q, e, 10)
    targets = q.select("query_id", (F.col("query_id") + 1).alias("vec_id"))
    return targets.join(found, ["query_id", "vec_id"], "left").select("query_id", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"))


@query("win_07_z_scores", f"""WITH {REVIEWS_SQL}, d AS (SELECT "user", item, avg(rating) AS s FROM reviews GROUP BY ALL)
SELECT "user", item, round((s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-6), 5) AS z FROM d WINDOW w AS (PARTITION BY "user")""")  # fmt: skip
def z_scores(spark, sf_dir):
    scores = reviews(spark, sf_dir).groupBy("user", "item").agg(F.avg("rating").alias("s"))
    return R.z_scores(scores, ["user"], "s").select("user", "item", F.round("z", 5).alias("z"))


@query("agg_15_user_moments", f"""WITH {REVIEWS_SQL} SELECT "user", round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS deviation FROM reviews GROUP BY "user" """)
def user_moments(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("user").agg(F.round(F.avg("rating"), 6).alias("mean"), F.round(F.stddev_pop("rating"), 6).alias("deviation"))


@query("agg_18_warm_and_cold", POP + """
SELECT CASE WHEN p.item IS NULL THEN 'cold' ELSE 'warm' END AS part, count(*) AS n, round(avg(CASE WHEN rank BETWEEN 1 AND 50 THEN 1.0 ELSE 0.0 END), 8) AS recall FROM ranked r LEFT JOIN pop p USING (item) GROUP BY part""")  # fmt: skip
def warm_and_cold(spark, sf_dir):
    split = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")
    train = split.filter("split = 'train'")
    pop = R.popularity(train)
    ranks = R.popularity_target_ranks(train, split.filter("split = 'test'").select("user", "item"), pop)
    part = ranks.join(pop.select("item", "pop_rank"), "item", "left").withColumn("part", F.when(F.col("pop_rank").isNull(), "cold").otherwise("warm"))
    return R.loo_metrics(part, (50,), by="part").select("part", "n", "recall")


@query("agg_28_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("mean"))


@query("set_05_new_candidates", TOPK.format("") + "SELECT query_id, rank, vec_id FROM r WHERE rank > 5 AND rank <= 10")
def new_candidates(spark, sf_dir):
    from wickerloom.operators.vectors import vector_topk

    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    ten = materialise(vector_topk(q, e, 10), "ten")
    return ten.join(ten.filter("rank <= 5").select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti").select("query_id", "rank", "vec_id")


@query("sort_09_first_occurrences", """
WITH x AS (SELECT item_index, unnest(features) AS f, generate_subscripts(features, 1) AS p FROM product_catalog), y AS (SELECT item_index, trim(f) AS f, p FROM x WHERE f IS NOT NULL AND trim(f) <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY item_index, lower(f) ORDER BY p) AS k FROM y)
SELECT item_index, string_agg(f, '|' ORDER BY p) AS features FROM z WHERE k = 1 GROUP BY item_index""")  # fmt: skip
def first_occurrences(spark, sf_dir):
    f = S.first_occurrences(F.col("features"))
    return table(spark, sf_dir, "product_catalog").select("item_index", F.array_join(f, "|").alias("features")).filter("features <> ''")


_SAMPLE = "CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT)"


@query("smp_01_sample", f"SELECT doc_id FROM documents ORDER BY {_SAMPLE}, doc_id LIMIT 200")
def sample(spark, sf_dir):
    return hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200, 42)


@query("smp_01_grouped_sample", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_SAMPLE}, doc_id) AS k FROM documents) WHERE k <= 5")
def grouped_sample(spark, sf_dir):
    return hash_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 5, 42, ["source"])


@query("smp_02_negative_samples", """
WITH pos AS (SELECT DISTINCT user_indices AS "user", item_indices AS item FROM train WHERE user_indices >= 0), it AS (SELECT item_index AS item, row_number() OVER (ORDER BY item_index) - 1 AS item_id FROM product_catalog),
d AS (SELECT "user", pos.item, draw, r, CAST('0x' || substr(md5('7:' || "user" || ':' || pos.item || ':' || draw || ':' || r), 1, 15) AS BIGINT) % (SELECT count(*) FROM it) AS item_id FROM pos, (VALUES (0), (1)) a(draw), range(30) b(r)),
n AS (SELECT "user", d.item, draw, r, it.item AS negative FROM d JOIN it USING (item_id)), g AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos."user" = n."user" AND pos.item = n.negative))
SELECT "user", item, draw, arg_min(negative, r) AS negative FROM g GROUP BY ALL""")  # fmt: skip
def negatives(spark, sf_dir):
    pos = table(spark, sf_dir, "train").filter("user_indices >= 0").select(F.col("user_indices").alias("user"), F.col("item_indices").alias("item")).distinct()
    items = materialise(I.dense_ids(table(spark, sf_dir, "product_catalog").select(F.col("item_index").alias("item"), F.col("item_index").alias("o")), "item", "o").withColumnRenamed("dense_id", "item_id"), "items")
    return negative_samples(pos, items, 2, 7)


@query("str_12_normal_form")
def normal_form(spark, sf_dir):
    """Titles, stores and features in normal form; DuckDB has neither NFKC nor case folding."""
    c = table(spark, sf_dir, "product_catalog")
    texts = F.concat(F.array("title", "store"), F.coalesce("features", F.array().cast("array<string>")))
    each = c.select(F.explode(texts).alias("text")).filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return each.select("text", S.normal_form("text").alias("normal"), "n")


def _plain_sql(c: str) -> str:
    return f"regexp_replace({c}, '([.*+?^$()|\\[\\]{{}}\\\\])', '\\\\\\1', 'g')"


@query("str_08_without_store", f"SELECT item_index, CASE WHEN coalesce(store, '') = '' THEN title ELSE regexp_replace(title, {_plain_sql('store')}, ' ', 'gi') END AS title FROM product_catalog")
def without_store(spark, sf_dir):
    """Titles without the seller's name, in any case."""
    return table(spark, sf_dir, "product_catalog").select("item_index", X.without_identifier(F.col("title"), F.col("store")).alias("title"))


@query("str_09_feature_query", f"""
WITH x AS (SELECT item_index, unnest(features) AS f, generate_subscripts(features, 1) AS p FROM product_catalog), y AS (SELECT item_index, p, trim({sql_clean('f')}, ' ,;:-') AS f FROM x WHERE f IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY item_index, lower(f) ORDER BY p) AS k FROM y WHERE f <> ''), w AS (SELECT item_index, f, row_number() OVER (PARTITION BY item_index ORDER BY p) AS place FROM z WHERE k = 1),
q AS (SELECT item_index, string_split(string_agg(f, ' ; ' ORDER BY place), ' ') AS words FROM w WHERE place <= 3 GROUP BY item_index)
SELECT item_index, 'Looking for a product with these features: ' || array_to_string(words[1:36], ' ') AS query FROM q""")  # fmt: skip
def feature_query(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").select("item_index", X.feature_query(F.col("features")).alias("query")).filter("query is not null")


_CUT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(({c})[1:{n - 3}], '\\s\\S*$', '') || '...' END"


BLOCK_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY rating_number DESC NULLS LAST, item_index) AS rank FROM product_catalog)
SELECT item_index, concat_ws(chr(10), '[Product ' || rank || ']', 'Product ID: ' || parent_asin, CASE WHEN {sql_clean('title')} <> '' THEN 'Title: ' || {sql_clean('title')} END,
  CASE WHEN isfinite(price) AND price > 0 THEN 'Price: $' || printf('%.2f', price) END, CASE WHEN isfinite(average_rating) THEN 'Average Rating: ' || printf('%.1f', average_rating) || ' / 5' END,
  CASE WHEN rating_number >= 0 THEN 'Rating Count: ' || rating_number END, CASE WHEN {sql_clean('store')} <> '' THEN 'Store: ' || {sql_clean('store')} END,
  CASE WHEN len({_list('categories')}) > 0 THEN 'Categories: ' || array_to_string({_list('categories')}, ' > ') END,
  CASE WHEN len({_list('features')}) > 0 THEN 'Features:' || chr(10) || array_to_string(list_transform(({_list('features')})[1:5], lambda f: '- ' || f), chr(10)) END,
  CASE WHEN {sql_clean('description')} <> '' THEN 'Description: ' || {_CUT(sql_clean('description'), 500)} END) AS block FROM r"""


@query("str_18_product_block", BLOCK_SQL)
def product_block(spark, sf_dir):
    ranked = I.global_rank(table(spark, sf_dir, "product_catalog"), F.desc_nulls_last("rating_number"), "item_index")
    return ranked.select("item_index", X.product_block(F.col("rank")).alias("block"))


@query("math_01_scores", "SELECT item_index, round(greatest(0, least(1, coalesce(CASE WHEN isfinite(average_rating) THEN average_rating END, 0) / 5)), 6) AS rating_score, round(ln(1 + greatest(0, coalesce(rating_number, 0))), 6) AS count_score FROM product_catalog")
def scores(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").select("item_index", F.round(S.rating_score(F.col("average_rating")), 6).alias("rating_score"), F.round(S.count_score(F.col("rating_number")), 6).alias("count_score"))


@query("math_11_pairwise_loss", """
WITH p AS (SELECT u.vec_id, list_dot_product(u.embedding::DOUBLE[], a.embedding::DOUBLE[]) - list_dot_product(u.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
  list_dot_product(u.embedding::DOUBLE[], u.embedding::DOUBLE[]) + list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w
  FROM embeddings u JOIN embeddings a ON a.vec_id = u.vec_id + 1 JOIN embeddings b ON b.vec_id = u.vec_id + 2)
SELECT count(*) AS n, round(avg(ln(1 + exp(-d))), 6) AS ranking, round(1e-4 * 0.5 * sum(w) / count(*), 8) AS regularisation, round(avg(ln(1 + exp(-d))) + 1e-4 * 0.5 * sum(w) / count(*), 6) AS loss FROM p""")  # fmt: skip
def pairwise_loss(spark, sf_dir):
    """The loss of one batch: a user's vector with a positive's and a negative's, over all dimensions, and the weights' norm."""
    from wickerloom.operators.vectors import dot

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    after = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("u").alias(n))
    u, a, b = (F.col(c) for c in "uab")
    rows = e.join(after(1, "a"), "vec_id").join(after(2, "b"), "vec_id").select(S.pairwise_loss(dot(u, a), dot(u, b)).alias("l"), (dot(u, u) + dot(a, a) + dot(b, b)).alias("w"))
    ranking, weights = F.avg("l"), 1e-4 * 0.5 * F.sum("w") / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(ranking, 6).alias("ranking"), F.round(weights, 8).alias("regularisation"), F.round(ranking + weights, 6).alias("loss"))


@query("json_01_malformed_lines", "SELECT CASE WHEN interaction_id % 3 = 0 THEN '{\"user\": ' || interaction_id ELSE '[' || interaction_id || ',' END AS line FROM enriched_interactions WHERE interaction_id % 3 < 2")
def malformed_lines(spark, sf_dir):
    """A file with a line per interaction, two of three broken, read back line by line."""
    i = F.col("interaction_id").cast("string")
    line = F.when(F.col("interaction_id") % 3 == 0, F.concat(F.lit('{"user": '), i)).when(F.col("interaction_id") % 3 == 1, F.concat(F.lit("["), i, F.lit(","))).otherwise(F.concat(F.lit('{"user": '), i, F.lit("}")))
    path = f"{shared_dir(spark)}/wickerloom/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "enriched_interactions").select(line.alias("value")).write.text(path)
    return io.malformed_lines(spark, path, T.StructType([T.StructField("user", T.LongType())])).select("line")


@query("join_15_retention", TOPK.format("") + """
, c AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY label, rank) AS place FROM r WHERE rank <= 50)
SELECT query_id, count(*) FILTER (WHERE rank <= 10) AS kept, round(avg(rank), 6) AS mean_rank, count(*) FILTER (WHERE rank > 20) AS beyond_20, max(rank - place) AS best_rise FROM c WHERE place <= 10 GROUP BY query_id""")  # fmt: skip
def retention(spark, sf_dir):
    from wickerloom.operators.vectors import vector_topk

    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_topk(q, e, 50).join(e.select("vec_id", "label"), "vec_id")
    moved = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "rank"))).filter("place <= 10")
    return moved.groupBy("query_id").agg(F.count_if(F.col("rank") <= 10).alias("kept"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank") > 20).alias("beyond_20"), F.max(F.col("rank") - F.col("place")).cast("long").alias("best_rise"))


@query("stream_event_windows", "SELECT epoch_ms(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The windows as a stream leaves them once it has read all files there are."""
    rows = read_table_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    # a watermark as wide as this leaves no row out, however late it comes
    counted = run_once(windowed_counts(rows, late="36500 days"), f"{shared_dir(spark)}/wickerloom/stream-{uuid.uuid4().hex}")
    return counted.select(F.unix_millis("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

"""Queries on product documents, known-item retrieval, recommendations for any user, and artefact checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.operators import hybrid as H
from wickerloom.operators import interactions as I
from wickerloom.operators import ranking as R
from wickerloom.operators import text as X
from wickerloom.operators import vectors as V
from wickerloom.plans.registry import Registry
from wickerloom.plans.splits import POP
from wickerloom.plans.texts import _list, packed_sql, sql_clean, sql_collapse
from wickerloom.plans.vectors import DOT, EVERY, TOPK
from wickerloom.session import materialise
from wickerloom.sources.tables import reviews, table

DOCUMENTS = Registry()
query = DOCUMENTS.query
K = 10
WRAPPERS = ["supports", "includes", "comes as", "version:", "you get", "this one is the"]


_NUMBER = "regexp_replace(printf('%.6f', {}), '\\.?0+$', '')".format


@query("str_20_knowledge_chunks", f"""
WITH s AS (SELECT item_index, parent_asin, 'summary' AS chunk_type, coalesce(nullif(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN len({_list('categories')}) > 0 THEN 'Categories: ' || array_to_string({_list('categories')}, ' | ') END,
    CASE WHEN NOT isnan(price) THEN 'Price: ' || {_NUMBER('price')} END, CASE WHEN NOT isnan(average_rating) THEN 'Average rating: ' || {_NUMBER('average_rating')} || CASE WHEN rating_number IS NOT NULL THEN ' (' || rating_number || ' ratings)' ELSE '' END END), ''), 'Parent ASIN: ' || parent_asin) AS t FROM product_catalog
  UNION ALL SELECT item_index, parent_asin, 'features', array_to_string(list_filter(features, lambda f: f IS NOT NULL), chr(10)) FROM product_catalog UNION ALL SELECT item_index, parent_asin, 'description', description FROM product_catalog),
w AS (SELECT item_index, parent_asin, chunk_type, list_filter(string_split({sql_collapse('t')}, ' '), lambda x: x <> '') AS ws FROM s), p AS (SELECT item_index, parent_asin, chunk_type, {packed_sql('ws', 1600)} AS parts FROM w WHERE len(ws) > 0),
e AS (SELECT item_index, parent_asin, chunk_type, generate_subscripts(parts, 1) - 1 AS part_index, unnest(parts) AS text FROM p)
SELECT item_index || ':' || chunk_type || ':' || part_index AS chunk_id, * FROM e""")  # fmt: skip
def knowledge_chunks(spark, sf_dir):
    return X.knowledge_chunks(table(spark, sf_dir, "product_catalog")).withColumn("part_index", F.col("part_index").cast("long"))


@query("str_06_parsed_text", f"""
SELECT item_index, nullif({sql_clean('title')}, '') AS title, coalesce(len({_list('categories')}), 0) AS n_categories, len(list_filter(list_transform(flatten(list_transform(coalesce({_list('features')}, []), lambda f: string_split(f, '|'))), lambda f: trim(f)), lambda f: f <> '')) AS n_features, nullif({sql_clean('description')}, '') AS description
FROM product_catalog""")  # fmt: skip
def parsed_text(spark, sf_dir):
    # a feature that holds the mark between features is read as several
    parsed = X.parse_product_text(X.product_text(table(spark, sf_dir, "product_catalog")))
    return parsed.select("item_index", "title", F.size("categories").cast("long").alias("n_categories"), F.size("features").cast("long").alias("n_features"), "description")


@query("str_03_details", "SELECT event_id, string_agg(k.unnest || ': ' || json_extract_string(props, k.unnest), ' | ') AS details FROM events, unnest(json_keys(props)) AS k GROUP BY event_id")
def details(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.details_text(F.from_json("props", "map<string,string>")).alias("details")).filter("details <> ''")


def _unwrapped_sql(c: str) -> str:
    whens = " ".join(f"WHEN starts_with({c}, '{p if not p[-1].isalnum() else p + ' '}') THEN trim(substr({c}, {len(p) + 1 + p[-1].isalnum()}))" for p in sorted(WRAPPERS, key=len, reverse=True))
    return f"CASE {whens} ELSE {c} END"


@query("str_14_unwrapped_features", f"""
SELECT feature, count(*) AS n FROM (SELECT {_unwrapped_sql('f')} AS feature FROM (SELECT lower({sql_clean('x')}) AS f FROM (SELECT unnest(features) AS x FROM product_catalog) WHERE x IS NOT NULL)) WHERE feature <> '' GROUP BY feature""")  # fmt: skip
def unwrapped_features(spark, sf_dir):
    f = table(spark, sf_dir, "product_catalog").select(F.explode("features").alias("x")).filter("x is not null").select(F.lower(X.clean_text(F.col("x"))).alias("f"))
    return f.groupBy(X.without_prefix(F.col("f"), WRAPPERS).alias("feature")).agg(F.count(F.lit(1)).alias("n")).filter("feature <> ''")


@query("join_03_encoded_users", "SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS dense_id FROM events WHERE user_id IS NOT NULL")
def encoded_users(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", "user_id")
    ids = I.dense_ids(events.select("user_id", F.col("user_id").alias("o")), "user_id", "o")
    return I.encode(events, "user_id", ids)


@query("agg_17_known_item_retrieval", f"""
WITH q AS (SELECT 'title' AS kind, vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0
  UNION ALL SELECT 'feature', a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + 2 * CAST(z[2] AS DOUBLE)) FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % {EVERY} = 0),
s AS (SELECT kind, query_id, vec_id, row_number() OVER (PARTITION BY kind, query_id ORDER BY {DOT.format(a='q.e', b='v.embedding')} DESC, vec_id) AS rank FROM q, embeddings v),
t AS (SELECT kind, CASE WHEN rank <= 20 THEN rank ELSE 0 END AS rank FROM s WHERE query_id = vec_id)
SELECT kind, count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
  round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1.0 ELSE 0 END), 6) AS recall_20, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM t GROUP BY kind""")  # fmt: skip
def known_item_retrieval(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = e.filter(F.col("vec_id") % EVERY == 0)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    mixed = own.join(after, "vec_id").select("vec_id", F.zip_with("embedding", "b", lambda x, y: x.cast("double") + 2 * y.cast("double")).alias("embedding"))
    out = None
    for kind, q in (("title", own.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))), ("feature", mixed)):
        queries = q.select(F.col("vec_id").alias("query_id"), "embedding")
        found = V.vector_topk(queries, e, 20).filter(F.col("query_id") == F.col("vec_id")).select("query_id", "rank")
        one = queries.select("query_id").join(found, "query_id", "left").select(F.lit(kind).alias("kind"), F.coalesce("rank", F.lit(0)).alias("rank"))
        out = one if out is None else out.unionByName(one)
    r = F.col("rank")
    recall = [F.round(F.avg(F.when((r > 0) & (r <= k), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 5, 10, 20)]
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *recall, F.round(F.avg(F.when(r > 0, 1 / r).otherwise(0.0)), 6).alias("mrr"))


@query("rec_07_recommend_to_all", POP + f"""
, u AS (SELECT DISTINCT o_custkey AS "user" FROM orders), c AS (
  SELECT u."user", p.item, p.pop_rank, row_number() OVER (PARTITION BY u."user" ORDER BY p.pop_rank) AS rank FROM u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = u."user" AND s.pop_rank = p.pop_rank))
SELECT c."user", CASE WHEN EXISTS (SELECT 1 FROM train t WHERE t."user" = c."user") THEN 'known' ELSE 'fallback' END AS status, rank, item, round(1.0 / pop_rank, 8) AS score FROM c WHERE rank <= {K}""")  # fmt: skip
def recommend_to_all(spark, sf_dir):
    train = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))).filter("split = 'train'"), "train")
    pop = R.popularity(train)
    users = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user")).distinct()
    known = train.select("user").distinct().withColumn("known", F.lit(True))
    top = R.popularity_topk(train, users, pop, K).join(pop.select("item", "pop_rank"), "item").join(known, "user", "left")
    return top.select("user", F.when(F.col("known"), "known").otherwise("fallback").alias("status"), "rank", "item", F.round(1 / F.col("pop_rank"), 8).alias("score"))


@query("rec_04_factorised_topk")
def factorised_topk(spark, sf_dir):
    """Implicit-feedback matrix factorisation in the place of the graph model; no equality with it is claimed."""
    from pyspark.ml.recommendation import ALS

    rows = table(spark, sf_dir, "train").filter("user_indices >= 0").distinct().withColumn("seen", F.lit(1.0))
    model = ALS(rank=16, maxIter=5, implicitPrefs=True, userCol="user_indices", itemCol="item_indices", ratingCol="seen", seed=1).fit(rows)
    # recommendForAllUsers scores every user with every item
    users, items = (f.select(F.col("id").alias(name), F.col("features").alias("embedding")) for f, name in ((model.userFactors, "query_id"), (model.itemFactors, "vec_id")))
    top = V.topk_by_length(users, items, K)
    return top.select(F.col("query_id").alias("user_indices"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("int").alias("item_indices"), F.col("score").alias("rating"))


@query("met_06_metric_records", POP + """
, m AS (SELECT k, count(*) FILTER (WHERE rank BETWEEN 1 AND k) AS numerator, count(*) AS denominator FROM ranked, (VALUES (10), (20), (50)) v(k) GROUP BY k)
SELECT 'recall' AS metric, k, numerator, denominator, round(numerator / denominator, 8) AS value, denominator > 0 AND numerator BETWEEN 0 AND denominator AS valid FROM m""")  # fmt: skip
def metric_records(spark, sf_dir):
    """Recall as records of a numerator, a denominator and their checked ratio."""
    split = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")
    train = split.filter("split = 'train'")
    ranks = R.popularity_target_ranks(train, split.filter("split = 'test'").select("user", "item"), R.popularity(train))
    each = ranks.select("rank", F.explode(F.array(*map(F.lit, (10, 20, 50)))).alias("k"))
    m = each.groupBy("k").agg(F.count_if((F.col("rank") > 0) & (F.col("rank") <= F.col("k"))).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    valid = (F.col("denominator") > 0) & F.col("numerator").between(0, F.col("denominator"))
    return m.select(F.lit("recall").alias("metric"), "k", "numerator", "denominator", F.round(F.col("numerator") / F.col("denominator"), 8).alias("value"), valid.alias("valid"))


@query("dq_01_catalogue_errors", """
WITH e AS (SELECT item_index, list_filter([CASE WHEN item_index IS NULL OR item_index < 0 THEN 'item_index' END, CASE WHEN parent_asin IS NULL OR trim(parent_asin) = '' THEN 'parent_asin' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END,
  CASE WHEN NOT isfinite(price) OR price <= 0 THEN 'price' END, CASE WHEN average_rating NOT BETWEEN 0 AND 5 THEN 'average_rating' END, CASE WHEN rating_number < 0 THEN 'rating_number' END], lambda x: x IS NOT NULL) AS errors FROM product_catalog)
SELECT item_index, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0""")  # fmt: skip
def catalogue_errors(spark, sf_dir):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    p = F.col("price")
    checks = {
        "item_index": F.col("item_index").isNull() | (F.col("item_index") < 0), "parent_asin": blank("parent_asin"), "title": blank("title"), "price": F.isnan(p) | (F.abs(p) == float("inf")) | (p <= 0),
        "average_rating": ~F.col("average_rating").between(0, 5), "rating_number": F.col("rating_number") < 0,
    }
    errors = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())
    return table(spark, sf_dir, "product_catalog").select("item_index", F.array_join(errors, ",").alias("errors")).filter("errors <> ''")


@query("dq_04_embedding_set", """
SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, count(*) FILTER (WHERE embedding IS NULL) AS missing, count(DISTINCT len(embedding)) AS n_dimensions,
  count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 2e-4) AS not_unit FROM embeddings""")  # fmt: skip
def embedding_set(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", "embedding", V.norm(F.col("embedding")).alias("l"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_distinct(F.size("embedding")).alias("n_dimensions"), F.count_if(F.abs(F.col("l") - 1) > 2e-4).alias("not_unit"))


@query("dq_07_bundle", POP + """
, h AS (SELECT "user", count(DISTINCT item) AS n FROM train GROUP BY "user"), o AS (SELECT n, sum(n) OVER (ORDER BY "user") - n AS start, row_number() OVER (ORDER BY "user") AS row FROM h)
SELECT (SELECT count(*) FROM pop ANTI JOIN (SELECT DISTINCT item FROM train) t USING (item)) AS unobserved_in_popularity, (SELECT count(*) FROM (SELECT DISTINCT item FROM train) t ANTI JOIN pop USING (item)) AS missing_in_popularity,
       (SELECT count(*) FROM pop) - (SELECT max(pop_rank) FROM pop) AS rank_gaps, (SELECT count(*) FROM o) AS n_rows, (SELECT CAST(max(start + n) AS BIGINT) FROM o) AS n_entries, (SELECT count(*) FROM o WHERE n = 0) AS empty_rows""")  # fmt: skip
def bundle(spark, sf_dir):
    """Popularity against the training items, and the offsets of the users' histories against their entries."""
    train = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))).filter("split = 'train'"), "train")
    pop = R.popularity(train)
    both = train.select("item").distinct().withColumn("o", F.lit(1)).join(pop.select("item", "pop_rank"), "item", "full_outer")
    items = both.agg(F.count_if(F.col("o").isNull()).alias("unobserved_in_popularity"), F.count_if(F.col("pop_rank").isNull()).alias("missing_in_popularity"), (F.count("pop_rank") - F.max("pop_rank")).alias("rank_gaps"))
    offsets = I.history_offsets(train, "user", "item")
    rows = offsets.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.col("start") + F.col("n")).alias("n_entries"), F.count_if(F.col("n") == 0).alias("empty_rows"))
    # one row each
    return items.crossJoin(rows)


@query("dq_10_candidate_lists", TOPK.format("") + f"""
, c AS (SELECT query_id, count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(rank) AS a, max(rank) AS z, count(DISTINCT rank) AS n_ranks FROM r WHERE rank <= {K} GROUP BY query_id)
SELECT count(*) AS lists, count(*) FILTER (WHERE n > {K}) AS too_long, count(*) FILTER (WHERE n_ids < n) AS repeats, count(*) FILTER (WHERE a <> 1 OR z <> n OR n_ranks < n) AS bad_ranks FROM c""")  # fmt: skip
def candidate_lists(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = V.vector_topk(e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e, K)
    c = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min("rank").alias("a"), F.max("rank").alias("z"), F.count_distinct("rank").alias("n_ranks"))
    n = F.col("n")
    return c.agg(F.count(F.lit(1)).alias("lists"), F.count_if(n > K).alias("too_long"), F.count_if(F.col("n_ids") < n).alias("repeats"), F.count_if((F.col("a") != 1) | (F.col("z") != n) | (F.col("n_ranks") < n)).alias("bad_ranks"))


@query("math_09_cold_aware_fusion", TOPK.format("") + f""", t AS (SELECT DISTINCT item_indices % (SELECT count(*) FROM embeddings) AS vec_id FROM train)
SELECT query_id, r.vec_id, round(CASE WHEN t.vec_id IS NOT NULL THEN 0.3 / rank + 0.7 * score ELSE score END, 6) AS fused FROM r LEFT JOIN t USING (vec_id) WHERE rank <= {K}""")  # fmt: skip
def cold_aware_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    found = V.vector_topk(e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e, K)
    seen = table(spark, sf_dir, "train").select(F.pmod("item_indices", F.lit(n)).alias("vec_id")).distinct().withColumn("seen", F.lit(True))
    fused = H.fuse(1 / F.col("rank"), F.col("score"), 0.7, F.coalesce("seen", F.lit(False)))
    return found.join(seen, "vec_id", "left").select("query_id", "vec_id", F.round(fused, 6).alias("fused"))

"""Queries on what a serving process loads, ranks and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.operators import catalogue as C
from wickerloom.operators import hybrid as H
from wickerloom.operators import interactions as I
from wickerloom.operators import ranking as R
from wickerloom.operators import serving as V
from wickerloom.operators import text as X
from wickerloom.operators import vectors as N
from wickerloom.operators.sampling import hash_sample
from wickerloom.plans.more import BLOCK_SQL
from wickerloom.plans.registry import Registry
from wickerloom.plans.splits import METRICS, POP
from wickerloom.plans.texts import _list, sql_clean
from wickerloom.plans.vectors import SEMANTIC, TOPK, _queries, _semantic
from wickerloom.session import materialise
from wickerloom.sources.tables import REVIEWS_SQL, reviews, table

SERVING = Registry()
query = SERVING.query
K = 10
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("src_04_first_matches", f"WITH {REVIEWS_SQL} SELECT p_partkey AS item, p_name FROM part SEMI JOIN reviews ON item = p_partkey AND rating >= 4 ORDER BY p_partkey LIMIT 10")
def first_matches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_name")
    return V.first_matches(parts, reviews(spark, sf_dir).filter("rating >= 4"), "item", "item")


@query("src_06_split_checks", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS n_null, min({c})::BIGINT AS least, max({c})::BIGINT AS most FROM train" for c in ("user_indices", "item_indices")))
def split_checks(spark, sf_dir):
    expected = T.StructType([T.StructField("user_indices", T.IntegerType()), T.StructField("item_indices", T.IntegerType())])
    return V.column_checks(V.checked_schema(table(spark, sf_dir, "train"), expected))


@query("src_09_canonical_catalogue", f"""
SELECT row_number() OVER (ORDER BY item_index) - 1 AS serving_row, item_index, trim(parent_asin) AS parent_asin, nullif({sql_clean('title')}, '') AS title, CASE WHEN isfinite(price) AND price > 0 THEN price END AS price,
  coalesce(array_to_string({_list('categories')}, '|'), '') AS categories, coalesce(array_to_string({_list('features')}, '|'), '') AS features FROM product_catalog""")  # fmt: skip
def canonical_catalogue(spark, sf_dir):
    c = table(spark, sf_dir, "product_catalog")
    return V.canonical_catalogue(c, c.select("item_index")).withColumn("categories", F.array_join("categories", "|")).withColumn("features", F.array_join("features", "|"))


@query("src_10_texts_in_order", f"""
SELECT row_number() OVER (ORDER BY item_index) - 1 AS serving_row, coalesce({sql_clean('title')}, '') || chr(10) || coalesce(array_to_string({_list('features')}, ' | '), '') AS text FROM product_catalog""")  # fmt: skip
def texts_in_order(spark, sf_dir):
    rows = V.canonical_catalogue(table(spark, sf_dir, "product_catalog"), table(spark, sf_dir, "product_catalog").select("item_index"))
    return rows.select("serving_row", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.array_join("features", " | ")).alias("text"))


_METRIC_ROWS = f"""{POP}, m AS (SELECT {METRICS} FROM ranked), v AS (SELECT k, CASE k WHEN 10 THEN r10 WHEN 20 THEN r20 ELSE r50 END AS recall, CASE k WHEN 10 THEN g10 WHEN 20 THEN g20 ELSE g50 END AS ndcg FROM m, (VALUES (10), (20), (50)) x(k)),
metric AS (SELECT 'Recall' AS metric, k, round(recall, 8) AS value FROM v UNION ALL SELECT 'NDCG', k, round(ndcg, 8) FROM v)"""


def _popularity_metrics(spark, sf_dir, unseen_only=True):
    split = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")
    train, targets = split.filter("split = 'train'"), split.filter("split = 'test'").select("user", "item")
    pop = R.popularity(train)
    if unseen_only:
        return R.loo_metrics(R.popularity_target_ranks(train, targets, pop))
    return R.loo_metrics(targets.join(pop.select("item", F.col("pop_rank").alias("rank")), "item", "left").select("user", "item", F.coalesce("rank", F.lit(0)).alias("rank")))


@query("src_16_metrics_from_report", _METRIC_ROWS + " SELECT metric, k, value FROM metric")
def metrics_from_report(spark, sf_dir):
    lines = V.report_lines(_popularity_metrics(spark, sf_dir))
    heading = spark.createDataFrame([("# Report",), ("| Metric | Value |",), ("| --- | ---: |",)], "line string")
    return V.read_report(heading.unionByName(lines))


@query("sup_32_metric_deltas", _METRIC_ROWS + f""", u AS (SELECT t."user", coalesce(p.pop_rank, 0) AS rank FROM target t LEFT JOIN pop p USING (item)), um AS (SELECT {METRICS} FROM u),
uv AS (SELECT k, CASE k WHEN 10 THEN r10 WHEN 20 THEN r20 ELSE r50 END AS recall, CASE k WHEN 10 THEN g10 WHEN 20 THEN g20 ELSE g50 END AS ndcg FROM um, (VALUES (10), (20), (50)) x(k)),
base AS (SELECT 'Recall' AS metric, k, round(recall, 8) AS baseline FROM uv UNION ALL SELECT 'NDCG', k, round(ndcg, 8) FROM uv)
SELECT metric, k, value, baseline, round(value - baseline, 8) AS delta, CASE WHEN baseline <> 0 THEN round(100 * (value - baseline) / baseline, 4) END AS percent FROM metric JOIN base USING (metric, k)""")  # fmt: skip
def metric_deltas(spark, sf_dir):
    """Popularity among unseen items against popularity alone."""
    rows = lambda m: V.read_report(V.report_lines(m))
    return V.metric_deltas(rows(_popularity_metrics(spark, sf_dir)), rows(_popularity_metrics(spark, sf_dir, False)))


_JSON = ("item_index", "parent_asin", "rating_number", "categories", "store")


@query("json_02_safe_json", "SELECT item_index, CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in _JSON) + "}) AS VARCHAR) AS json FROM product_catalog")
def safe_json(spark, sf_dir):
    c = table(spark, sf_dir, "product_catalog")
    return c.select("item_index", V.safe_json(c, _JSON).alias("json"))


@query("prj_01_structured_metadata", f"""
SELECT item_index, nullif({sql_clean('title')}, '') AS title, nullif({sql_clean('store')}, '') AS store, CASE WHEN isfinite(price) THEN price END AS price, CASE WHEN isfinite(average_rating) THEN average_rating END AS average_rating, rating_number,
  coalesce(array_to_string({_list('categories')}, ' > '), '') AS category_path, coalesce(len({_list('features')}), 0) AS n_features FROM product_catalog""")  # fmt: skip
def structured_metadata(spark, sf_dir):
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    text = lambda c: F.nullif(X.clean_text(F.col(c)), F.lit("")).alias(c)
    return table(spark, sf_dir, "product_catalog").select("item_index", text("title"), text("store"), finite("price"), finite("average_rating"), "rating_number", F.array_join(X.clean_list(F.col("categories")), " > ").alias("category_path"), F.size(X.clean_list(F.col("features"))).cast("long").alias("n_features"))


@query("join_06_positional", """
WITH a AS (SELECT row_number() OVER (ORDER BY rating_number DESC NULLS LAST, item_index) AS position, item_index AS first FROM product_catalog), b AS (SELECT row_number() OVER (ORDER BY average_rating DESC NULLS LAST, item_index) AS position, item_index AS second FROM product_catalog)
SELECT position, first, second, first IS NOT DISTINCT FROM second AS same FROM a FULL JOIN b USING (position)""")  # fmt: skip
def positional(spark, sf_dir):
    c = table(spark, sf_dir, "product_catalog").select("item_index", "rating_number", "average_rating")
    a, b = (I.global_rank(c, F.desc_nulls_last(by), "item_index", name="position") for by in ("rating_number", "average_rating"))
    return V.positional(a, b, "item_index")


@query("sort_07_sorted_lookup", "SELECT row_number() OVER (ORDER BY encode(parent_asin)) - 1 AS position, parent_asin, item_index FROM product_catalog")
def sorted_lookup(spark, sf_dir):
    return V.sorted_lookup(table(spark, sf_dir, "product_catalog"), "parent_asin", "item_index")


@query("dq_08_lookup_checks", "WITH l AS (SELECT item_index, parent_asin, lag(parent_asin) OVER (ORDER BY encode(parent_asin)) AS before, row_number() OVER (ORDER BY encode(parent_asin)) - 1 AS p FROM product_catalog) SELECT count(*) AS n, count(*) FILTER (WHERE parent_asin <= before) AS n_not_ascending, count(DISTINCT p) = count(*) AND min(p) = 0 AND max(p) = count(*) - 1 AS positions_whole, count(DISTINCT item_index) = count(*) AND min(item_index) = 0 AND max(item_index) = count(*) - 1 AS values_whole FROM l")
def lookup_checks(spark, sf_dir):
    lookup = materialise(V.sorted_lookup(table(spark, sf_dir, "product_catalog"), "parent_asin", "item_index"), "lookup")
    return V.lookup_checks(lookup, "parent_asin", "item_index")


@query("sup_08_alignment", """
WITH e AS (SELECT DISTINCT vec_id FROM embeddings), c AS (SELECT DISTINCT item_index FROM product_catalog), s AS (SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dimensions, max(vec_id) - min(vec_id) + 1 AS span FROM embeddings)
SELECT s.n AS n_vectors, (SELECT count(*) FROM c) AS n_items, dimensions, span = s.n AS ids_whole, (SELECT count(*) FROM e ANTI JOIN c ON vec_id = item_index) AS vectors_without_item, (SELECT count(*) FROM c ANTI JOIN e ON vec_id = item_index) AS items_without_vector FROM s""")  # fmt: skip
def alignment(spark, sf_dir):
    e, c = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "product_catalog").select(F.col("item_index").cast("long").alias("vec_id"))
    both = I.reconcile(e, c, "vec_id")
    shape = e.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct(F.size("embedding")).alias("dimensions"), (F.max("vec_id") - F.min("vec_id") + 1 == F.count(F.lit(1))).alias("ids_whole"))
    # one row each
    return shape.crossJoin(both).select("n_vectors", (F.col("in_both") + F.col("only_second")).alias("n_items"), "dimensions", "ids_whole", F.col("only_first").alias("vectors_without_item"), F.col("only_second").alias("items_without_vector"))


@query("sup_21_sample_check", f"""
WITH s AS (SELECT * FROM product_catalog ORDER BY CAST('0x' || substr(md5('21:' || item_index), 1, 15) AS BIGINT), item_index LIMIT 200), k AS (SELECT item_index, count(*) AS n_chunks, count(*) FILTER (WHERE parent_asin IS NOT NULL) AS n_named, min(parent_asin) AS a, max(parent_asin) AS z FROM chunks GROUP BY item_index)
SELECT s.item_index, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_named = 0 OR (a = s.parent_asin AND z = s.parent_asin), true) AS agrees,
  (CASE WHEN {sql_clean('title')} <> '' THEN 1 ELSE 0 END + CASE WHEN price > 0 THEN 1 ELSE 0 END + CASE WHEN len(features) > 0 THEN 1 ELSE 0 END + CASE WHEN {sql_clean('description')} <> '' THEN 1 ELSE 0 END) AS n_fields FROM s LEFT JOIN k USING (item_index)""")  # fmt: skip
def sample_check(spark, sf_dir):
    drawn = hash_sample(table(spark, sf_dir, "product_catalog"), "item_index", 200, 21)
    chunks = table(spark, sf_dir, "chunks").groupBy("item_index").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("parent_asin").alias("n_named"), F.min("parent_asin").alias("a"), F.max("parent_asin").alias("z"))
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    fields = has(X.clean_text(F.col("title")) != "") + has(F.col("price") > 0) + has(F.size("features") > 0) + has(X.clean_text(F.col("description")) != "")
    agrees = F.coalesce((F.col("n_named") == 0) | ((F.col("a") == F.col("parent_asin")) & (F.col("z") == F.col("parent_asin"))), F.lit(True))
    return drawn.join(chunks, "item_index", "left").select("item_index", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), agrees.alias("agrees"), fields.alias("n_fields"))


@query("sup_27_ranking_guards", POP + f""", g AS (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY pop_rank) AS rank FROM (SELECT DISTINCT "user", item FROM train) JOIN pop USING (item)),
k AS (SELECT "user", count(*) AS n, count(DISTINCT item) AS i, max(rank) AS z, count(DISTINCT rank) AS r FROM g WHERE rank <= {K} GROUP BY "user")
SELECT 0 AS bad_cutoffs, count(*) AS n_users, count(*) FILTER (WHERE i < n) AS repeated_items, count(*) FILTER (WHERE z <> n OR r < n) AS broken_ranks, count(*) FILTER (WHERE "user" NOT IN (SELECT "user" FROM target)) AS without_truth FROM k""")  # fmt: skip
def ranking_guards(spark, sf_dir):
    split = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")
    train = split.filter("split = 'train'")
    mine = train.select("user", "item").join(R.popularity(train).select("item", "pop_rank"), "item")
    return V.ranking_guards(R.top_per_group(mine, ["user"], [F.col("pop_rank")], K), split.filter("split = 'test'"), (10, 20, 50))


_STATS = f"""st AS (WITH {REVIEWS_SQL} SELECT item % (SELECT count(*) FROM embeddings) AS vec_id, avg(rating) AS rating, ln(1 + count(*)) AS popularity FROM reviews GROUP BY 1)"""


@query("rec_08_rerank_by_weights", TOPK.format("") + f""", {_STATS},
c AS (SELECT query_id, rank AS retrieval_rank, vec_id, score, rating, coalesce(popularity, 0) AS popularity FROM r LEFT JOIN st USING (vec_id) WHERE rank <= 50 AND rating >= 2.9),
x AS (SELECT *, min(popularity) OVER w AS p0, max(popularity) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, round(0.7 * score + 0.2 * greatest(0, least(1, coalesce(rating, 0) / 5)) + 0.1 * CASE WHEN p1 > p0 THEN (popularity - p0) / (p1 - p0) ELSE 0 END, 9) AS final FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, score DESC, retrieval_rank, vec_id) AS place FROM f)
SELECT query_id, place AS rank, vec_id, round(final, 6) AS final, retrieval_rank FROM o WHERE place <= {K}""")  # fmt: skip
def rerank_by_weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    stats = reviews(spark, sf_dir).groupBy(F.pmod("item", F.lit(n)).alias("vec_id")).agg(F.avg("rating").alias("rating"), F.log1p(F.count(F.lit(1))).alias("popularity"))
    found = N.vector_topk(_queries(spark, sf_dir), e, 50).withColumnRenamed("rank", "retrieval_rank").join(stats, "vec_id", "left").fillna(0.0, ["popularity"])
    return H.rerank_by_weights(found.filter("rating >= 2.9"), K).withColumn("final", F.round("final", 6))


_GRID = ", ".join(f"({a})" for a in ALPHAS)
_GRID_SQL = SEMANTIC + f""", al AS (SELECT CAST(alpha AS DOUBLE) AS alpha FROM (VALUES {_GRID}) v(alpha)), va AS (SELECT * FROM (VALUES ('uniform'), ('cold_aware')) v(variant)),
tg AS (SELECT split, "user", item % size.n AS vec_id FROM split, size WHERE split IN ('valid', 'test')),
fu AS (SELECT variant, alpha, "user", vec_id, round(CASE WHEN variant = 'cold_aware' AND n = 0 THEN z ELSE (1 - alpha) * zp + alpha * z END, 9) AS t FROM zs, al, va),
mk AS (SELECT split, variant, alpha, "user", tg.vec_id, t AS mark, EXISTS (SELECT 1 FROM sn WHERE sn."user" = tg."user" AND sn.vec_id = tg.vec_id) AS gone FROM tg JOIN fu USING ("user", vec_id)),
un AS (SELECT fu.* FROM fu ANTI JOIN sn USING ("user", vec_id)),
rk AS (SELECT mk.split, mk.variant, mk.alpha, mk."user", CASE WHEN any_value(gone) THEN 0 ELSE 1 + count(un.vec_id) END AS rank FROM mk LEFT JOIN un
  ON un.variant = mk.variant AND un.alpha = mk.alpha AND un."user" = mk."user" AND un.vec_id <> mk.vec_id AND (un.t > mk.mark OR (un.t = mk.mark AND un.vec_id < mk.vec_id)) GROUP BY mk.split, mk.variant, mk.alpha, mk."user"),
me AS (SELECT split, variant, alpha, round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1.0 ELSE 0.0 END), 8) AS recall, round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1 / log2(rank + 1) ELSE 0.0 END), 8) AS ndcg FROM rk GROUP BY ALL),
be AS (SELECT variant, alpha FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ndcg DESC, alpha) AS p FROM me WHERE split = 'valid') WHERE p = 1)"""


def _grid(spark, sf_dir, split_name, alphas):
    """(variant, alpha, recall, ndcg) at 20 of one split's targets."""
    profiles, e, seen, counts, _ = _semantic(spark, sf_dir, 0.0)
    n = e.count()
    split = I.temporal_split(I.positives(reviews(spark, sf_dir)))
    targets = split.filter(F.col("split") == split_name).select("user", F.pmod("item", F.lit(n)).alias("vec_id"))
    ranks = materialise(H.target_ranks(profiles, e, counts, targets, alphas, seen), "ranks").withColumn("by", F.struct("variant", "alpha"))
    return R.loo_metrics(ranks, (20,), by="by").select("by.*", "recall", "ndcg")


@query("rec_06_alpha_grid", _GRID_SQL + " SELECT variant, alpha, recall, ndcg, EXISTS (SELECT 1 FROM be WHERE be.variant = me.variant AND be.alpha = me.alpha) AS chosen FROM me WHERE split = 'valid'")
def alpha_grid(spark, sf_dir):
    grid = materialise(_grid(spark, sf_dir, "valid", ALPHAS), "grid")
    # the best NDCG, of equal ones the first alpha
    best = R.top_per_group(grid, ["variant"], [F.desc("ndcg"), F.col("alpha")], 1).select("variant", "alpha", F.lit(True).alias("chosen"))
    return grid.join(best, ["variant", "alpha"], "left").fillna(False, ["chosen"])


@query("sort_08_best_alpha", _GRID_SQL + " SELECT me.variant, me.alpha, me.recall, me.ndcg FROM me JOIN be USING (variant, alpha) WHERE split = 'test'")
def best_alpha(spark, sf_dir):
    """Alpha chosen on valid targets only; test targets are ranked under the chosen ones."""
    best = R.top_per_group(_grid(spark, sf_dir, "valid", ALPHAS), ["variant"], [F.desc("ndcg"), F.col("alpha")], 1).select("variant", "alpha")
    # two rows: one a variant
    chosen = [(r.variant, r.alpha) for r in best.collect()]
    test = _grid(spark, sf_dir, "test", sorted({a for _, a in chosen}))
    return test.join(spark.createDataFrame(chosen, "variant string, alpha double"), ["variant", "alpha"])


@query("win_07_catalogue_z", SEMANTIC + " SELECT \"user\", vec_id, round(z, 6) AS z FROM zs SEMI JOIN sn USING (\"user\", vec_id)")
def catalogue_z(spark, sf_dir):
    """z-scores of each user's own items among the scores of the whole catalogue."""
    profiles, e, seen, _, _ = _semantic(spark, sf_dir, 1.0)
    return H.pair_z_scores(seen, profiles, e).withColumn("z", F.round("z", 6))


#: Eligible vectors: the category mask of the serving queries.
MASK = "label % 3 <> 0"
_STATES = f"""rq AS (SELECT c_custkey AS request FROM customer UNION ALL SELECT -c_custkey FROM customer),
ok AS (SELECT vec_id FROM embeddings WHERE {MASK}),
s3 AS (SELECT request, CASE WHEN request IN (SELECT "user" FROM pf) THEN 'personalized' WHEN request IN (SELECT c_custkey FROM customer) THEN 'canonical_known_model_unseen' ELSE 'unknown_user' END AS status FROM rq)"""


@query("rec_07_identity_aware", SEMANTIC + f""", {_STATES},
rk AS (SELECT "user", vec_id, round(0.3 * zp + 0.7 * z, 9) AS score FROM zs ANTI JOIN sn USING ("user", vec_id) WHERE vec_id IN (SELECT vec_id FROM ok)),
nb AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, vec_id) AS rank FROM rk),
po AS (SELECT vec_id, row_number() OVER (ORDER BY n DESC, vec_id) AS pop_rank FROM pc), fb AS (SELECT vec_id, 1 / pop_rank AS score, row_number() OVER (ORDER BY pop_rank) AS rank FROM po SEMI JOIN ok USING (vec_id))
SELECT request, status, rank, vec_id, round(score, 6) AS score FROM s3 JOIN nb ON "user" = request WHERE status = 'personalized' AND rank <= {K}
UNION ALL SELECT request, status, rank, vec_id, round(score, 6) FROM s3, fb WHERE status <> 'personalized' AND rank <= {K}""")  # fmt: skip
def identity_aware(spark, sf_dir):
    """Known users of the model get the hybrid ranking, others the popular items; both among the eligible ones only, never relaxed."""
    profiles, e, seen, counts, alpha = _semantic(spark, sf_dir, 0.7)
    eligible = e.filter(MASK).select("vec_id")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("request"))
    requests = known.unionByName(known.select((-F.col("request")).alias("request")))
    status = F.when(F.col("m"), "personalized").when(F.col("c"), "canonical_known_model_unseen").otherwise("unknown_user")
    profiles = materialise(profiles, "profiles")
    marked = requests.join(known.withColumn("c", F.lit(True)), "request", "left").join(profiles.select(F.col("user").cast("long").alias("request"), F.lit(True).alias("m")), "request", "left").select("request", status.alias("status"))
    mine = H.profile_scores(profiles, e, K, counts, alpha, seen, eligible=eligible).withColumnRenamed("user", "request")
    popular = I.global_rank(counts, F.desc("n"), "vec_id", name="pop_rank").join(eligible, "vec_id", "left_semi").orderBy("pop_rank").limit(K)
    # K rows for everybody
    listed = popular.agg(F.array_sort(F.collect_list(F.struct("pop_rank", "vec_id"))).alias("l")).select(F.posexplode("l").alias("p", "x")).select((F.col("p") + 1).alias("rank"), "x.vec_id", (1 / F.col("x.pop_rank")).alias("score"))
    others = marked.filter("status <> 'personalized'").crossJoin(F.broadcast(listed))
    rows = marked.filter("status = 'personalized'").join(mine, "request").select("request", "status", "rank", "vec_id", "score").unionByName(others.select("request", "status", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return rows.withColumn("score", F.round("score", 6))


@query("flt_04_hard_constraints", "SELECT item_index FROM product_catalog WHERE isfinite(average_rating) AND average_rating >= 4.2 AND rating_number >= 50 AND average_rating <= 4.8")
def hard_constraints(spark, sf_dir):
    """Inclusive bounds on both sides of a rating and below a count; what is unknown is out."""
    ok = C.within("average_rating", 4.2, 4.8) & F.coalesce(F.col("rating_number") >= 50, F.lit(False))
    return table(spark, sf_dir, "product_catalog").filter(ok).select("item_index")


@query("win_10_top_movers", TOPK.format("") + f""", {_STATS},
c AS (SELECT query_id, rank AS retrieval_rank, vec_id, score, rating, coalesce(popularity, 0) AS popularity FROM r LEFT JOIN st USING (vec_id) WHERE rank <= 20),
x AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(popularity) OVER w AS p0, max(popularity) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, round(0.7 * CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 1 END + 0.2 * greatest(0, least(1, coalesce(rating, 0) / 5)) + 0.1 * CASE WHEN p1 > p0 THEN (popularity - p0) / (p1 - p0) ELSE 0 END, 9) AS final FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, score DESC, retrieval_rank, vec_id) AS place FROM f), m AS (SELECT query_id, vec_id, retrieval_rank - place AS change FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY change DESC, vec_id) AS up, row_number() OVER (PARTITION BY query_id ORDER BY change, vec_id) AS down FROM m)
SELECT query_id, 'up' AS direction, up AS place, vec_id, change FROM u WHERE up <= 3 UNION ALL SELECT query_id, 'down', down, vec_id, change FROM u WHERE down <= 3""")  # fmt: skip
def top_movers(spark, sf_dir):
    """Of each query's reranked pool, the three that rose and the three that fell most."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    stats = reviews(spark, sf_dir).groupBy(F.pmod("item", F.lit(n)).alias("vec_id")).agg(F.avg("rating").alias("rating"), F.log1p(F.count(F.lit(1))).alias("popularity"))
    found = N.vector_topk(_queries(spark, sf_dir), e, 20).withColumnRenamed("rank", "retrieval_rank").join(stats, "vec_id", "left").fillna(0.0, ["popularity"])
    moved = materialise(H.rerank(found, 20, 20).select("query_id", "vec_id", "change"), "moved")
    up, down = (R.top_per_group(moved, ["query_id"], [order, F.col("vec_id")], 3, "place").select("query_id", F.lit(name).alias("direction"), "place", "vec_id", "change") for name, order in (("up", F.desc("change")), ("down", F.asc("change"))))
    return up.unionByName(down)


CONTEXT_BUDGET = 12_000


@query("ctx_01_context_blocks", f"""
WITH b AS ({BLOCK_SQL}), r AS (SELECT c.item_index, lower(trim(c.store)) AS store, row_number() OVER (PARTITION BY lower(trim(c.store)) ORDER BY rating_number DESC NULLS LAST, c.item_index) AS rank, length(block) AS l FROM product_catalog c JOIN b USING (item_index) WHERE trim(c.store) <> ''),
u AS (SELECT *, sum(l) OVER (PARTITION BY store ORDER BY rank) + 2 * (rank - 1) AS used FROM r)
SELECT store, item_index, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= {CONTEXT_BUDGET}""")  # fmt: skip
def context_blocks(spark, sf_dir):
    """Per seller, the product blocks in rank order that fit a prompt of 12,000 characters, a blank line between them."""
    c = table(spark, sf_dir, "product_catalog")
    ranked = I.global_rank(c, F.desc_nulls_last("rating_number"), "item_index", name="overall")
    blocks = ranked.filter(F.trim("store") != "").select("item_index", "rating_number", F.lower(F.trim("store")).alias("store"), X.product_block(F.col("overall")).alias("block"))
    # a block has a line at least, so places beyond the budget can't fit; Spark cuts them before the shuffle
    first = R.top_per_group(blocks, ["store"], [F.desc_nulls_last("rating_number"), F.col("item_index")], CONTEXT_BUDGET)
    before = Window.partitionBy("store").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("used", F.sum(F.length("block")).over(before) + 2 * (F.col("rank") - 1)).filter(F.col("used") <= CONTEXT_BUDGET).select("store", "item_index", "rank", "used")

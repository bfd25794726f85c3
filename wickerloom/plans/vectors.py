"""Queries of §2.9 on vectors, hybrid ranking and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.operators import hybrid as H
from wickerloom.operators import interactions as I
from wickerloom.operators import vectors as V
from wickerloom.plans.registry import Registry
from wickerloom.plans.splits import POP, SPLIT
from wickerloom.session import materialise
from wickerloom.sources.tables import REVIEWS_SQL, reviews, table

VECTORS = Registry()
query = VECTORS.query
K = 10
#: A stated query set: every vector whose id is divisible by this, against all vectors.
EVERY = 20
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
TOPK = f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {DOT.format(a='q.embedding', b='v.embedding')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0 {{}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("agg_13_norm_statistics", """
WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l, len(embedding) AS d FROM embeddings)
SELECT count(*) AS n, round(min(l), 5) AS least, round(avg(l), 5) AS mean, round(max(l), 5) AS most, count(*) FILTER (WHERE NOT isfinite(l)) AS n_not_finite, count(*) FILTER (WHERE l = 0) AS n_zero,
       min(d) AS least_dimension, max(d) AS most_dimension FROM n""")  # fmt: skip
def norm_statistics(spark, sf_dir):
    return V.norm_statistics(table(spark, sf_dir, "embeddings"), "embedding")


@query("vec_01_topk", TOPK.format("") + f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}")
def topk(spark, sf_dir):
    return V.vector_topk(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), K).withColumn("score", F.round("score", 6))


@query("vec_02_restricted_topk", TOPK.format("AND v.label IN (SELECT label FROM embeddings WHERE vec_id = 0)") + f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}")
def restricted_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    candidates = e.join(e.filter("vec_id = 0").select("label"), "label", "left_semi").select("vec_id")
    return V.vector_topk(_queries(spark, sf_dir), e, K, candidates).withColumn("score", F.round("score", 6))


@query("vec_04_self_search", f"WITH a AS ({TOPK.format('')} SELECT query_id, vec_id FROM r WHERE rank = 1) SELECT count(*) AS n, count(*) FILTER (WHERE query_id = vec_id) AS found FROM a")
def self_search(spark, sf_dir):
    first = V.vector_topk(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 1)
    return first.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query_id") == F.col("vec_id")).alias("found"))


@query("vec_05_top3_per_candidate", TOPK.format("") + f""", c AS (SELECT DISTINCT query_id, label FROM r WHERE rank <= {K}),
p AS (SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s SEMI JOIN c USING (query_id, label))
SELECT query_id, label, rank, vec_id, round(score, 6) AS score FROM p WHERE rank <= 3""")  # fmt: skip
def top3_per_candidate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = _queries(spark, sf_dir)
    candidates = V.vector_topk(queries, e, K).join(e.select("vec_id", "label"), "vec_id").select("query_id", "label").distinct()
    return V.topk_per_candidate(queries, candidates, e, "label", 3).withColumn("score", F.round("score", 6))


@query("vec_07_neighbour_purity", TOPK.format("") + f"""SELECT query_id, round(avg(CASE WHEN r.label = o.label THEN 1.0 ELSE 0.0 END), 6) AS purity
FROM r JOIN embeddings o ON o.vec_id = query_id WHERE rank <= {K} GROUP BY query_id""")  # fmt: skip
def neighbour_purity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.label_neighbours(V.vector_topk(_queries(spark, sf_dir), e, K), e)


@query("agg_14_label_profiles", """
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL),
l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label)
SELECT label, pos - 1 AS pos, round(m / l, 6) AS x FROM m JOIN l USING (label)""")  # fmt: skip
def label_profiles(spark, sf_dir):
    profiles = V.mean_vectors(table(spark, sf_dir, "embeddings"), "label")
    return profiles.select("label", F.posexplode("profile").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _semantic(spark, sf_dir, alpha):
    """Users' profiles from the vectors of their train items, and the scores of all vectors for them."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    split = materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")
    train = split.filter("split = 'train'").select("user", F.pmod("item", F.lit(n)).alias("vec_id"))
    profiles = V.mean_vectors(train.join(e, "vec_id"), "user").select("user", "profile")
    counts = train.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    return profiles, e, train.distinct(), counts, alpha


#: Users' z-scores over all vectors: zs of the semantic scores, zp of popularity in train.
SEMANTIC = f"""{SPLIT}, size AS (SELECT count(*) AS n FROM embeddings), tr AS (SELECT "user", item % n AS vec_id FROM split, size WHERE split = 'train'),
ex AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mv AS (SELECT "user", pos, avg(CAST(x AS DOUBLE)) AS x FROM tr JOIN ex USING (vec_id) GROUP BY ALL),
pf AS (SELECT "user", list(x ORDER BY pos) AS p, sqrt(sum(x * x)) AS l FROM mv GROUP BY "user"),
pc AS (SELECT vec_id, count(*) AS n FROM tr GROUP BY vec_id),
ct AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, coalesce(n, 0) AS n, (coalesce(n, 0) - avg(coalesce(n, 0)) OVER ()) / (stddev_pop(coalesce(n, 0)) OVER () + 1e-6) AS zp FROM embeddings LEFT JOIN pc USING (vec_id)),
sc AS (SELECT "user", vec_id, n, zp, list_dot_product(p, e) / l AS s FROM pf, ct),
zs AS (SELECT "user", vec_id, n, zp, (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-6) AS z FROM sc WINDOW w AS (PARTITION BY "user")),
sn AS (SELECT DISTINCT "user", vec_id FROM tr)"""


def _best_sql(alpha: float) -> str:
    return SEMANTIC + f""", rk AS (SELECT "user", vec_id, round({1 - alpha:.1f} * zp + {alpha} * z, 9) AS score FROM zs ANTI JOIN sn USING ("user", vec_id)),
nb AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, vec_id) AS rank FROM rk)
SELECT "user", rank, vec_id, round(score, 6) AS score FROM nb WHERE rank <= {K}"""


@query("rec_02_semantic_topk", _best_sql(1.0))
def semantic_topk(spark, sf_dir):
    profiles, e, seen, _, _ = _semantic(spark, sf_dir, 1.0)
    return H.profile_scores(profiles, e, K, seen=seen).withColumn("score", F.round("score", 6))


@query("rec_05_hybrid_topk", _best_sql(0.7))
def hybrid_topk(spark, sf_dir):
    profiles, e, seen, counts, alpha = _semantic(spark, sf_dir, 0.7)
    return H.profile_scores(profiles, e, K, counts, alpha, seen).withColumn("score", F.round("score", 6))


@query("rec_09_rerank", TOPK.format("") + f"""
, st AS (WITH {REVIEWS_SQL} SELECT item % (SELECT count(*) FROM embeddings) AS vec_id, avg(rating) AS rating, ln(1 + count(*)) AS popularity FROM reviews GROUP BY 1),
c AS (SELECT query_id, rank AS retrieval_rank, vec_id, score, rating, coalesce(popularity, 0) AS popularity FROM r LEFT JOIN st USING (vec_id) WHERE rank <= 20),
x AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(popularity) OVER w AS p0, max(popularity) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, round(0.7 * CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 1 END + 0.2 * greatest(0, least(1, coalesce(rating, 0) / 5)) + 0.1 * CASE WHEN p1 > p0 THEN (popularity - p0) / (p1 - p0) ELSE 0 END, 9) AS final FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, score DESC, retrieval_rank, vec_id) AS place FROM f)
SELECT query_id, place AS rank, vec_id, round(final, 6) AS final, retrieval_rank, retrieval_rank - place AS change FROM o WHERE place <= {K}""")  # fmt: skip
def rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    stats = reviews(spark, sf_dir).groupBy(F.pmod("item", F.lit(n)).alias("vec_id")).agg(F.avg("rating").alias("rating"), F.log1p(F.count(F.lit(1))).alias("popularity"))
    found = V.vector_topk(_queries(spark, sf_dir), e, 50).withColumnRenamed("rank", "retrieval_rank")
    candidates = found.join(stats, "vec_id", "left").fillna(0.0, ["popularity"])
    return H.rerank(candidates, K, 20).withColumn("final", F.round("final", 6))


GRAPH = f"""WITH {REVIEWS_SQL}, p AS (SELECT DISTINCT "user", item FROM reviews WHERE rating >= 4),
du AS (SELECT "user", count(*) AS d FROM p GROUP BY "user"), di AS (SELECT item, count(*) AS d FROM p GROUP BY item),
w AS (SELECT 'u' || "user" AS u, 'i' || item AS i, 1 / sqrt(du.d * di.d) AS w FROM p JOIN du USING ("user") JOIN di USING (item)),
g AS (SELECT u AS src, i AS dst, w FROM w UNION ALL SELECT i, u, w FROM w)"""


@query("grf_01_adjacency", GRAPH + " SELECT src, dst, round(w, 8) AS w FROM g")
def adjacency(spark, sf_dir):
    return H.edges(reviews(spark, sf_dir).filter("rating >= 4")).withColumn("w", F.round("w", 8))


@query("rec_03_propagation", GRAPH + """
, l0 AS (SELECT DISTINCT src AS node, CAST(hash_ AS DOUBLE) AS x FROM (SELECT src, length(src) + CAST(substr(src, 2) AS BIGINT) % 7 AS hash_ FROM g)),
l1 AS (SELECT dst AS node, sum(x * w) AS x FROM l0 JOIN g ON node = src GROUP BY dst), l2 AS (SELECT dst AS node, sum(x * w) AS x FROM l1 JOIN g ON node = src GROUP BY dst)
SELECT node, round(sum(x) / 3, 6) AS x FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY node""")  # fmt: skip
def propagation(spark, sf_dir):
    graph = materialise(H.edges(reviews(spark, sf_dir).filter("rating >= 4")), "graph")
    start = graph.select(F.col("src").alias("node")).distinct().select("node", F.lit(0).alias("pos"), (F.length("node") + F.substring("node", 2, 20).cast("long") % 7).cast("double").alias("x"))
    return H.propagate(graph, start, 2).select("node", F.round("x", 6).alias("x"))


@query("sort_02_top_items", POP + "SELECT item, n FROM pop ORDER BY n DESC, item LIMIT 50")
def top_items(spark, sf_dir):
    train = I.temporal_split(I.positives(reviews(spark, sf_dir))).filter("split = 'train'")
    # Spark keeps 50 a task
    return train.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(50)

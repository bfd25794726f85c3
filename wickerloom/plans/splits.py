"""Queries of §2.3, 2.5-2.7 and 2.9 on interactions: splits, k-core, popularity, metrics, set operations, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.operators import interactions as I
from wickerloom.operators import ranking as R
from wickerloom.plans.registry import Registry
from wickerloom.session import materialise
from wickerloom.sources.tables import REVIEWS_SQL, reviews, table

SPLITS = Registry()
query = SPLITS.query
K = 10
POSITIVES = f"""WITH {REVIEWS_SQL}, pos AS (SELECT "user", item, max(ts) AS ts FROM reviews WHERE rating >= 4 GROUP BY ALL)"""
SPLIT = f"""{POSITIVES},
marked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item DESC) AS back, count(*) OVER (PARTITION BY "user") AS n FROM pos),
split AS (SELECT "user", item, ts, CASE WHEN n < 3 THEN 'train' WHEN back = 1 THEN 'test' WHEN back = 2 THEN 'valid' ELSE 'train' END AS split FROM marked)"""
POP = f"""{SPLIT},
train AS (SELECT "user", item, ts FROM split WHERE split = 'train'),
pop AS (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS pop_rank FROM (SELECT item, count(*) AS n FROM train GROUP BY item)),
target AS (SELECT "user", item FROM split WHERE split = 'test'),
seen AS (SELECT DISTINCT "user", pop_rank FROM train JOIN pop USING (item)),
ranked AS (
  SELECT t."user", t.item, CASE WHEN p.pop_rank IS NULL THEN 0 ELSE p.pop_rank - (SELECT count(*) FROM seen s WHERE s."user" = t."user" AND s.pop_rank < p.pop_rank) END AS rank
  FROM target t LEFT JOIN pop p USING (item))"""
METRICS = ", ".join(
    f"avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END) AS r{k}, avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1 / log2(rank + 1) ELSE 0.0 END) AS g{k}" for k in (10, 20, 50)
)


def _split(spark, sf_dir):
    return materialise(I.temporal_split(I.positives(reviews(spark, sf_dir))), "split")


def _train(spark, sf_dir):
    s = _split(spark, sf_dir)
    return s, s.filter("split = 'train'")


@query("flt_03_positives", f"WITH {REVIEWS_SQL} SELECT rating, count(*) AS n FROM reviews WHERE rating >= 4 GROUP BY rating")
def positive_counts(spark, sf_dir):
    return reviews(spark, sf_dir).filter("rating >= 4").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query("win_01_latest_per_pair", POSITIVES + 'SELECT "user", item, ts FROM pos')
def latest_per_pair(spark, sf_dir):
    return I.positives(reviews(spark, sf_dir))


@query("win_02_temporal_split", SPLIT + 'SELECT "user", item, ts, split FROM split')
def temporal_split(spark, sf_dir):
    return I.temporal_split(I.positives(reviews(spark, sf_dir)))


@query("agg_11_split_statistics", SPLIT + 'SELECT split, count(*) AS n_rows, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items FROM split GROUP BY split')
def split_statistics(spark, sf_dir):
    return I.temporal_split(I.positives(reviews(spark, sf_dir))).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user").alias("n_users"), F.count_distinct("item").alias("n_items"))


@query("agg_12_universe_statistics", SPLIT + """
SELECT (SELECT count(*) FROM part) AS canonical, count(DISTINCT item) FILTER (WHERE split = 'train') AS observed,
       (SELECT count(*) FROM part) - count(DISTINCT item) FILTER (WHERE split = 'train') AS cold, (SELECT count(*) FROM part) - count(DISTINCT item) AS never_positive FROM split""")  # fmt: skip
def universe_statistics(spark, sf_dir):
    items = I.temporal_split(I.positives(reviews(spark, sf_dir))).groupBy("item").agg(F.max((F.col("split") == "train").cast("int")).alias("observed"))
    state = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")).join(items, "item", "left")
    return state.agg(F.count(F.lit(1)).alias("canonical"), F.count_if(F.col("observed") == 1).alias("observed"), F.count_if(F.coalesce("observed", F.lit(0)) == 0).alias("cold"), F.count_if(F.col("observed").isNull()).alias("never_positive"))


def _core_steps(k: int, source: str = "pos", prefix: str = "c", rounds: int = 14) -> tuple[list[str], str]:
    """CTEs of so many peeling rounds from source, more than the tables need, and the name of the last."""
    steps = [f"{prefix}0 AS (SELECT * FROM {source})"]
    for r in range(1, rounds + 1):
        p = f"{prefix}{r - 1}"
        steps.append(
            f'{prefix}{r} AS MATERIALIZED (SELECT * FROM {p} WHERE "user" IN (SELECT "user" FROM {p} GROUP BY "user" HAVING count(*) >= {k}) AND item IN (SELECT item FROM {p} GROUP BY item HAVING count(*) >= {k}))'
        )
    return steps, f"{prefix}{rounds}"


_STEPS, _LAST = _core_steps(8)
_CORE = POSITIVES + ", " + ", ".join(_STEPS)


def _sizes_sql(ks: list[int]) -> str:
    steps, out = [], []
    for k in ks:
        mine, last = _core_steps(k, prefix=f"k{k}_")
        steps += mine
        out.append(f'SELECT {k} AS k, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items, count(*) AS n_rows FROM {last}')
    return POSITIVES + ", " + ", ".join(steps) + " " + " UNION ALL ".join(out)


@query("kc_01_core", _CORE + f' SELECT "user", item, ts FROM {_LAST}')
def core(spark, sf_dir):
    return I.kcore(I.positives(reviews(spark, sf_dir)), 8)


@query("kc_02_core_sizes", _sizes_sql([3, 5, 8]))
def core_sizes(spark, sf_dir):
    return I.core_sizes(I.positives(reviews(spark, sf_dir)), [3, 5, 8])


@query("kc_03_core_items", _CORE + f" SELECT DISTINCT item, p_name FROM {_LAST} JOIN part ON p_partkey = item")
def core_items(spark, sf_dir):
    items = I.kcore(I.positives(reviews(spark, sf_dir)), 8).select("item").distinct()
    return items.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_name"), "item")


@query("agg_10_popularity_ranks", POP + "SELECT item, n, pop_rank FROM pop")
def popularity_ranks(spark, sf_dir):
    return R.popularity(_train(spark, sf_dir)[1])


@query("rec_01_popularity_topk", POP + f"""
, u AS (SELECT DISTINCT "user" FROM target), cand AS (
  SELECT u."user", p.item, row_number() OVER (PARTITION BY u."user" ORDER BY p.pop_rank) AS rank FROM u CROSS JOIN pop p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = u."user" AND s.pop_rank = p.pop_rank))
SELECT "user", rank, item FROM cand WHERE rank <= {K}""")  # fmt: skip
def popularity_topk(spark, sf_dir):
    split, train = _train(spark, sf_dir)
    pop = R.popularity(train)
    users = split.filter("split = 'test'").select("user")
    return R.popularity_topk(train, users, pop, K)


def _ranks(spark, sf_dir):
    split, train = _train(spark, sf_dir)
    pop = R.popularity(train)
    return R.popularity_target_ranks(train, split.filter("split = 'test'").select("user", "item"), pop), split, pop


@query("met_target_ranks", POP + 'SELECT "user", item, rank FROM ranked')
def target_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)[0]


@query("popularity_loo_metrics", POP + f"""
, m AS (SELECT count(*) AS n, {METRICS} FROM ranked)
SELECT k, n, round(CASE k WHEN 10 THEN r10 WHEN 20 THEN r20 ELSE r50 END, 8) AS recall, round(CASE k WHEN 10 THEN g10 WHEN 20 THEN g20 ELSE g50 END, 8) AS ndcg
FROM m, (VALUES (10), (20), (50)) v(k)""")  # fmt: skip
def popularity_loo_metrics(spark, sf_dir):
    return R.loo_metrics(_ranks(spark, sf_dir)[0])


@query("met_04_popular_and_rare_metrics", POP + f"""
, m AS (SELECT CASE WHEN p.pop_rank <= 100 THEN 'popular' ELSE 'rare' END AS part, count(*) AS n, {METRICS} FROM ranked LEFT JOIN pop p USING (item) GROUP BY part)
SELECT part, k, n, round(CASE k WHEN 10 THEN r10 WHEN 20 THEN r20 ELSE r50 END, 8) AS recall, round(CASE k WHEN 10 THEN g10 WHEN 20 THEN g20 ELSE g50 END, 8) AS ndcg
FROM m, (VALUES (10), (20), (50)) v(k)""")  # fmt: skip
def popular_and_rare_metrics(spark, sf_dir):
    ranks, _, pop = _ranks(spark, sf_dir)
    part = F.when(F.col("pop_rank") <= 100, "popular").otherwise("rare")
    return R.loo_metrics(ranks.join(pop.select("item", "pop_rank"), "item", "left").withColumn("part", part), by="part")


@query("met_05_mean_reciprocal_rank", POP + """
SELECT count(*) AS n, round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1.0 / rank ELSE 0.0 END), 8) AS mrr, count(*) FILTER (WHERE NOT rank BETWEEN 1 AND 20) AS misses FROM ranked""")  # fmt: skip
def mean_reciprocal_rank(spark, sf_dir):
    return R.mean_reciprocal_rank(_ranks(spark, sf_dir)[0])


@query("met_01_multi_relevant", POP + """
, truth AS (SELECT "user", item FROM split WHERE split IN ('valid', 'test')), hit AS (
  SELECT t."user", count(*) AS m, count(*) FILTER (WHERE p.pop_rank <= 20) AS h, coalesce(sum(1 / log2(p.pop_rank + 1)) FILTER (WHERE p.pop_rank <= 20), 0) AS d
  FROM truth t LEFT JOIN pop p USING (item) GROUP BY t."user")
SELECT 20 AS k, count(*) AS n_users, round(avg(h / m), 8) AS recall, round(avg(d / list_sum(list_transform(range(1, least(20, m) + 1), lambda i: 1 / log2(i + 1)))), 8) AS ndcg FROM hit""")  # fmt: skip
def multi_relevant(spark, sf_dir):
    split, train = _train(spark, sf_dir)
    top = R.popularity(train).filter("pop_rank <= 20").select(F.col("pop_rank").alias("rank"), "item")
    truth = split.filter("split in ('valid', 'test')").select("user", "item")
    # one list for everybody: of it, only the places of a user's own relevant items matter
    ranking = truth.join(top, "item")
    return R.rank_metrics(ranking, truth, [20])


@query("join_04_unseen_items", POP + 'SELECT count(*) AS n FROM target t ANTI JOIN train s ON s."user" = t."user" AND s.item = t.item')
def unseen_targets(spark, sf_dir):
    split, train = _train(spark, sf_dir)
    return split.filter("split = 'test'").join(train.select("user", "item"), ["user", "item"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("join_02_known_pairs", """
SELECT e.interaction_id, e.user_indices, e.item_indices FROM enriched_interactions e
JOIN (SELECT DISTINCT user_indices FROM train) u USING (user_indices) JOIN (SELECT DISTINCT item_indices FROM train) i USING (item_indices)""")  # fmt: skip
def known_pairs(spark, sf_dir):
    train = table(spark, sf_dir, "train")
    e = table(spark, sf_dir, "enriched_interactions").select("interaction_id", "user_indices", "item_indices")
    return e.join(train.select("user_indices").distinct(), "user_indices", "left_semi").join(train.select("item_indices").distinct(), "item_indices", "left_semi")


@query("join_13_reconcile_items", """
WITH a AS (SELECT DISTINCT item_indices AS i FROM train), b AS (SELECT DISTINCT item_indices AS i FROM enriched_interactions WHERE item_indices IS NOT NULL)
SELECT (SELECT count(*) FROM a JOIN b USING (i)) AS in_both, (SELECT count(*) FROM a ANTI JOIN b USING (i)) AS only_first, (SELECT count(*) FROM b ANTI JOIN a USING (i)) AS only_second""")  # fmt: skip
def reconcile_items(spark, sf_dir):
    other = table(spark, sf_dir, "enriched_interactions").filter("item_indices is not null")
    return I.reconcile(table(spark, sf_dir, "train"), other, "item_indices")


@query("join_14_missing_targets", "SELECT DISTINCT c.item_index FROM product_catalog c ANTI JOIN train t ON t.item_indices = c.item_index")
def missing_targets(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").select("item_index").distinct().join(table(spark, sf_dir, "train").select(F.col("item_indices").alias("item_index")), "item_index", "left_anti")


@query("join_05_ordered_lookup", """
WITH r AS (SELECT user_indices AS request, row_number() OVER (PARTITION BY user_indices ORDER BY item_indices) - 1 AS pos, item_indices AS item_index FROM (SELECT DISTINCT * FROM train WHERE user_indices >= 0))
SELECT request, pos, item_index, parent_asin FROM r LEFT JOIN product_catalog USING (item_index)""")  # fmt: skip
def ordered_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "train").filter("user_indices >= 0").groupBy(F.col("user_indices").alias("request")).agg(F.array_sort(F.collect_set("item_indices")).alias("ids"))
    names = table(spark, sf_dir, "product_catalog").select("item_index", "parent_asin")
    return I.ordered_lookup(requests, names, "item_index").select("request", F.col("pos").cast("long").alias("pos"), "item_index", "parent_asin")


@query("win_15_dense_ids", """
SELECT parent_asin, row_number() OVER (ORDER BY first, parent_asin) - 1 AS dense_id FROM (SELECT parent_asin, min(chunk_index) AS first FROM chunks WHERE parent_asin IS NOT NULL GROUP BY parent_asin)""")  # fmt: skip
def dense_ids(spark, sf_dir):
    return I.dense_ids(table(spark, sf_dir, "chunks").filter("parent_asin is not null"), "parent_asin", "chunk_index")


@query("win_13_history_offsets", """
WITH c AS (SELECT user_indices, count(DISTINCT item_indices) AS n FROM train WHERE user_indices >= 0 GROUP BY user_indices)
SELECT user_indices, n, CAST(sum(n) OVER (ORDER BY user_indices) - n AS BIGINT) AS start FROM c""")  # fmt: skip
def history_offsets(spark, sf_dir):
    return I.history_offsets(table(spark, sf_dir, "train").filter("user_indices >= 0"), "user_indices", "item_indices")


@query("win_14_adjacent_violations", """
SELECT count(*) FILTER (WHERE ts < before) AS unsorted, count(*) FILTER (WHERE ts = before) AS ties FROM
(SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")  # fmt: skip
def adjacent_violations(spark, sf_dir):
    # neighbours in the whole order are matched by their places, so a user's events need not be in one task
    placed = materialise(I.global_rank(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", name="at"), "placed")
    before = placed.select((F.col("at") + 1).alias("at"), F.col("user_id").alias("of"), F.col("ts").alias("before"))
    return placed.join(before, "at").filter(F.col("user_id").eqNullSafe(F.col("of"))).agg(F.count_if(F.col("ts") < F.col("before")).alias("unsorted"), F.count_if(F.col("ts") == F.col("before")).alias("ties"))


@query("set_01_all_users", SPLIT + "SELECT DISTINCT \"user\" FROM split WHERE split IN ('train', 'valid') UNION SELECT \"user\" FROM split WHERE split = 'test'")
def all_users(spark, sf_dir):
    s = _split(spark, sf_dir)
    return s.filter("split <> 'test'").select("user").unionByName(s.filter("split = 'test'").select("user")).distinct()


@query("set_02_split_overlaps", SPLIT + """
SELECT 'train-test' AS pair, count(*) AS n FROM (SELECT "user", item FROM split WHERE split = 'train' INTERSECT SELECT "user", item FROM split WHERE split = 'test')
UNION ALL SELECT 'train-valid', count(*) FROM (SELECT "user", item FROM split WHERE split = 'train' INTERSECT SELECT "user", item FROM split WHERE split = 'valid')
UNION ALL SELECT 'valid-test', count(*) FROM (SELECT "user", item FROM split WHERE split = 'valid' INTERSECT SELECT "user", item FROM split WHERE split = 'test')""")  # fmt: skip
def split_overlaps(spark, sf_dir):
    # one pass instead of three intersections: a pair that stands in two splits shows in its set of splits
    pairs = _split(spark, sf_dir).groupBy("user", "item").agg(*(F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "valid", "test")))
    one = pairs.agg(F.count_if((F.col("train") == 1) & (F.col("test") == 1)).alias("a"), F.count_if((F.col("train") == 1) & (F.col("valid") == 1)).alias("b"), F.count_if((F.col("valid") == 1) & (F.col("test") == 1)).alias("c"))
    return one.select(F.expr("stack(3, 'train-test', a, 'train-valid', b, 'valid-test', c) as (pair, n)"))


@query("set_03_unknown_users", 'SELECT user_indices FROM enriched_interactions WHERE user_indices IS NOT NULL EXCEPT SELECT user_indices FROM train')
def unknown_users(spark, sf_dir):
    """Users of the interactions that the training set doesn't know."""
    return table(spark, sf_dir, "enriched_interactions").select("user_indices").filter("user_indices is not null").distinct().join(table(spark, sf_dir, "train").select("user_indices"), "user_indices", "left_anti")


@query("set_04_same_users", SPLIT + """
SELECT (SELECT count(*) FROM (SELECT "user" FROM split WHERE split = 'valid' EXCEPT SELECT "user" FROM split WHERE split = 'test')) AS only_valid,
       (SELECT count(*) FROM (SELECT "user" FROM split WHERE split = 'test' EXCEPT SELECT "user" FROM split WHERE split = 'valid')) AS only_test""")  # fmt: skip
def same_users(spark, sf_dir):
    s = _split(spark, sf_dir)
    return I.reconcile(s.filter("split = 'valid'"), s.filter("split = 'test'"), "user").select(F.col("only_first").alias("only_valid"), F.col("only_second").alias("only_test"))


@query("set_06_permutation", "SELECT count(*) = count(DISTINCT chunk_index) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS is_permutation FROM chunks")
def permutation(spark, sf_dir):
    c = F.col("chunk_index")
    return table(spark, sf_dir, "chunks").agg(((F.count(F.lit(1)) == F.count_distinct(c)) & (F.min(c) == 0) & (F.max(c) == F.count(F.lit(1)) - 1)).alias("is_permutation"))


@query("set_07_reconstruction", SPLIT + """, parts AS (SELECT "user", item, ts FROM split WHERE split = 'train' UNION ALL SELECT "user", item, ts FROM split WHERE split = 'valid' UNION ALL SELECT "user", item, ts FROM split WHERE split = 'test')
SELECT (SELECT CAST(count(*) AS INTEGER) FROM (SELECT "user", item, ts FROM pos EXCEPT ALL SELECT "user", item, ts FROM parts)) AS lost, (SELECT CAST(count(*) AS INTEGER) FROM (SELECT "user", item, ts FROM parts EXCEPT ALL SELECT "user", item, ts FROM pos)) AS added, (SELECT count(*) FROM parts) AS n_rows""")
def reconstruction(spark, sf_dir):
    s, pos = _split(spark, sf_dir), materialise(I.positives(reviews(spark, sf_dir)), "positives")
    parts = s.filter("split = 'train'").unionByName(s.filter("split = 'valid'")).unionByName(s.filter("split = 'test'")).select("user", "item", "ts")
    one, none = F.lit(1), F.lit(0)
    differences = pos.exceptAll(parts).select(one.alias("lost"), none.alias("added")).unionByName(parts.exceptAll(pos).select(none.alias("lost"), one.alias("added")))
    off = differences.agg(F.coalesce(F.sum("lost"), none).cast("int").alias("lost"), F.coalesce(F.sum("added"), none).cast("int").alias("added"))
    # one row each
    return off.crossJoin(parts.agg(F.count(one).alias("n_rows")))


@query("dq_05_split_order", SPLIT + """
, u AS (SELECT "user", max(ts) FILTER (WHERE split = 'train') AS a, max(ts) FILTER (WHERE split = 'valid') AS b, max(ts) FILTER (WHERE split = 'test') AS c FROM split GROUP BY "user")
SELECT count(*) AS n_users, count(*) FILTER (WHERE b < a) AS valid_before_train, count(*) FILTER (WHERE c < b) AS test_before_valid FROM u""")  # fmt: skip
def split_order(spark, sf_dir):
    u = I.temporal_split(I.positives(reviews(spark, sf_dir))).groupBy("user").agg(*(F.max(F.when(F.col("split") == s, F.col("ts"))).alias(s) for s in ("train", "valid", "test")))
    return u.agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("valid") < F.col("train")).alias("valid_before_train"), F.count_if(F.col("test") < F.col("valid")).alias("test_before_valid"))

"""Semantic profiles, score fusion, reranking and graph propagation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerloom.operators.ranking import min_max, top_per_group
from wickerloom.operators.vectors import as_matrix, best_columns, dot
from wickerloom.session import materialise

#: Vectors of a catalogue that one block holds, about, and entries of a block of users' scores.
MAX_CATALOGUE = 65_536
SCORES = 4_000_000


def edges(df: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of each distinct user and item, weighted 1 / sqrt(d_user * d_item); nodes are 'u' or 'i' and the id."""
    pairs = df.select("user", "item").distinct()
    du = pairs.groupBy("user").agg(F.count(F.lit(1)).alias("du"))
    di = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("di"))
    weighted = pairs.join(du, "user").join(di, "item").select(F.concat(F.lit("u"), "user").alias("u"), F.concat(F.lit("i"), "item").alias("i"), (1 / F.sqrt(F.col("du") * F.col("di"))).alias("w"))
    # one scan gives both directions
    return weighted.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("i").alias("dst"), "w"), F.struct(F.col("i").alias("src"), F.col("u").alias("dst"), "w"))).alias("e")).select("e.*")


def propagate(graph: DataFrame, values: DataFrame, layers: int) -> DataFrame:
    """(node, x): the mean of the values and their `layers` propagations over the graph; values: (node, pos, x).

    The graph is read once a layer, so it should be a table.
    """
    now, total = materialise(values, "layer"), values
    for _ in range(layers):
        step = now.join(graph, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "pos").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
        now = materialise(step, "layer")
        total = total.unionByName(now)
    return total.groupBy("node", "pos").agg((F.sum("x") / (layers + 1)).alias("x"))


def fuse(collaborative: Column, semantic: Column, alpha: float, observed: Column | None = None) -> Column:
    """(1 - alpha) c + alpha s; with observed, items that training never saw count by their semantic score alone."""
    mixed = (1 - alpha) * collaborative + alpha * semantic
    return mixed if observed is None else F.when(observed, mixed).otherwise(semantic)


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors; one row a partition reaches the driver."""

    def joined(x: tuple, y: tuple) -> tuple:
        (n, mean, m), (n2, mean2, m2) = x, y
        apart = mean2 - mean
        return n + n2, mean + apart * (n2 / (n + n2)), m + m2 + np.outer(apart, apart) * (n * n2 / (n + n2))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column(0))
                mean = x.mean(0)
                one = (len(x), mean, (x - mean).T @ (x - mean))
                held = one if held is None else joined(held, one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], ["n", "mean", "m"])

    held = None
    for row in vectors.select("embedding").mapInArrow(part, "n long, mean array<double>, m array<double>").toLocalIterator():
        mean = np.asarray(row.mean)
        one = (row.n, mean, np.asarray(row.m).reshape(len(mean), len(mean)))
        held = one if held is None else joined(held, one)
    return (held[0], held[1], held[2] / held[0]) if held else (0, np.empty(0), np.empty((0, 0)))


def profile_scores(profiles: DataFrame, vectors: DataFrame, k: int, popularity: DataFrame | dict[int, float] | None = None, alpha: float = 1.0, seen: DataFrame | None = None, epsilon: float = 1e-6, eligible: DataFrame | None = None) -> DataFrame:
    """(user, rank, vec_id, score): each user's k best vectors by z-scored semantic and popularity scores, without the seen ones.

    profiles: (user, profile); vectors: (vec_id, embedding); popularity: (vec_id, n) or a dict, 0 where it has none;
    eligible: (vec_id), all if not given. z-scores are over the whole catalogue, before seen and other ones are left out; a user's mean and deviation follow from the
    catalogue's mean and covariance. The catalogue is taken in blocks of about MAX_CATALOGUE vectors and products by
    blocks of users in one matrix product each; only the k best of a block leave a task. An empty catalogue gives no rows.
    """
    spark = profiles.sparkSession
    if not isinstance(popularity, DataFrame):
        popularity = spark.createDataFrame([(int(i), float(n)) for i, n in (popularity or {}).items()], "vec_id long, n double")
    catalogue, n, mean, covariance, of_pop = _catalogue(vectors, popularity, eligible)
    result = "user long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    rows = _with_seen(profiles.select("user", "profile").filter("profile is not null"), seen)
    blocks = -(-n // MAX_CATALOGUE)
    if blocks == 1:
        return rows.mapInArrow(_block_scores(catalogue, k, alpha, epsilon, mean, covariance, of_pop), result)
    rows, out = materialise(rows, "profiles"), None
    for b in range(blocks):
        block = catalogue.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        found = materialise(rows.mapInArrow(_block_scores(block, k, alpha, epsilon, mean, covariance, of_pop), result), "block")
        out = found if out is None else out.unionByName(found)
    best = top_per_group(out.drop("rank"), ["user"], [F.desc("score"), F.col("vec_id")], k)
    return best.select("user", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _catalogue(vectors: DataFrame, popularity: DataFrame, eligible: DataFrame | None = None):
    """(vec_id, embedding, pop, may) of the vectors, their number, mean and covariance, and the moments of popularity."""
    rows = vectors.select("vec_id", "embedding").join(popularity.select("vec_id", F.col("n").cast("double").alias("pop")), "vec_id", "left").fillna(0.0, ["pop"])
    if eligible is None:
        rows = rows.withColumn("may", F.lit(True))
    else:
        rows = rows.join(eligible.select("vec_id").distinct().withColumn("may", F.lit(True)), "vec_id", "left").fillna(False, ["may"])
    catalogue = materialise(rows, "catalogue")
    n, mean, covariance = _moments(catalogue)
    return catalogue, n, mean, covariance, catalogue.agg(F.avg("pop").alias("mean"), F.stddev_pop("pop").alias("deviation")).first()


def _with_seen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    if seen is None:
        return rows.withColumn("seen", F.array().cast("array<bigint>"))
    return rows.join(seen.groupBy("user").agg(F.collect_set("vec_id").alias("seen")), "user", "left")  # at most the catalogue's size


def pair_z_scores(pairs: DataFrame, profiles: DataFrame, vectors: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(user, vec_id, z) of each pair: the vector's score for the user, standardised over the user's scores of the whole catalogue.

    A user's mean and deviation follow from the catalogue's mean and covariance, so only the pairs are scored. Pairs
    without a profile or a vector are left out.
    """
    _, mean, covariance = _moments(vectors)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = as_matrix(b.column(1))
                deviation = np.sqrt(np.maximum(((p @ covariance) * p).sum(1), 0.0)) + epsilon
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p @ mean), pa.array(deviation)], ["user", "profile", "centre", "deviation"])

    rows = profiles.select(F.col("user").cast("long").alias("user"), F.col("profile").cast("array<double>").alias("profile")).filter("profile is not null")
    of_user = rows.mapInArrow(moments, "user long, profile array<double>, centre double, deviation double")
    scored = pairs.select("user", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(of_user, "user")
    return scored.select("user", "vec_id", ((dot(F.col("profile"), F.col("embedding")) - F.col("centre")) / F.col("deviation")).alias("z"))


def target_ranks(profiles: DataFrame, vectors: DataFrame, popularity: DataFrame, targets: DataFrame, alphas: Sequence[float], seen: DataFrame | None = None, epsilon: float = 1e-6) -> DataFrame:
    """(user, variant, alpha, rank): the target's place in each user's ranking under every alpha, for both ways of fusing.

    targets: (user, vec_id), one a user. uniform mixes both z-scores, cold_aware scores vectors without popularity by
    their semantic score alone. z-scores are as in profile_scores. A target that the user has seen has rank 0. Ranks are
    counts of what scores higher, so they add up over the catalogue's blocks and no list is built.
    """
    catalogue, n, mean, covariance, of_pop = _catalogue(vectors, popularity)
    result = "user long, variant string, alpha double, above long"
    own = catalogue.select("vec_id", F.col("embedding").alias("own"), F.col("pop").alias("own_pop"))
    rows = materialise(_with_seen(profiles.select("user", "profile").filter("profile is not null").join(targets.select("user", "vec_id"), "user").join(own, "vec_id"), seen).select("user", "profile", "seen", "vec_id", "own", "own_pop"), "targets")
    out, blocks = None, max(1, -(-n // MAX_CATALOGUE))
    for b in range(blocks):
        block = catalogue if blocks == 1 else catalogue.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        found = rows.mapInArrow(_block_ranks(block, alphas, epsilon, mean, covariance, of_pop), result)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("user", "variant", "alpha").agg(F.when(F.min("above") < 0, 0).otherwise(F.sum("above") + 1).cast("long").alias("rank"))


def _block_ranks(block: DataFrame, alphas: Sequence[float], epsilon: float, mean: np.ndarray, covariance: np.ndarray, of_pop):
    """The function that counts, for batches of targets, what of a block of the catalogue scores higher; -1 for a seen target."""
    t = block.orderBy("vec_id").toArrow()
    matrix = as_matrix(t.column("embedding")).reshape(-1, len(mean))
    shared = block.sparkSession.sparkContext.broadcast((np.asarray(t.column("vec_id"), np.int64), matrix, np.asarray(t.column("pop"), np.float64), mean, covariance))
    of_mean, of_deviation = of_pop.mean, of_pop.deviation

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, pop, mean, covariance = shared.value
        zpop, cold = (pop - of_mean) / (of_deviation + epsilon), pop == 0
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                p, own = as_matrix(b.column(1)), as_matrix(b.column(4))
                target, own_pop = np.asarray(b.column(3), np.int64), np.asarray(b.column(5), np.float64)
                deviation = np.sqrt(np.maximum(((p @ covariance) * p).sum(1), 0.0)) + epsilon
                centre = p @ mean
                z, z_own = (p @ matrix.T - centre[:, None]) / deviation[:, None], ((p * own).sum(1) - centre) / deviation
                zp_own = (own_pop - of_mean) / (of_deviation + epsilon)
                open_ = np.ones(z.shape, bool)
                gone = np.zeros(len(p), bool)
                for r, mine in enumerate(b.column(2).to_pylist()):
                    if mine:
                        open_[r, np.isin(ids, mine)] = False
                        gone[r] = target[r] in mine
                user = np.asarray(b.column(0), np.int64)
                for variant in ("uniform", "cold_aware"):
                    for alpha in alphas:
                        total, mark = (1 - alpha) * zpop[None, :] + alpha * z, (1 - alpha) * zp_own + alpha * z_own
                        if variant == "cold_aware":
                            total, mark = np.where(cold[None, :], z, total), np.where(own_pop == 0, z_own, mark)
                        total, mark = np.round(total, 9), np.round(mark, 9)[:, None]
                        higher = (total > mark) | ((total == mark) & (ids[None, :] < target[:, None]))
                        above = np.where(gone, -1, (higher & open_ & (ids[None, :] != target[:, None])).sum(1))
                        yield pa.RecordBatch.from_arrays([pa.array(user), pa.array([variant] * len(user)), pa.array(np.full(len(user), float(alpha))), pa.array(above.astype(np.int64))], ["user", "variant", "alpha", "above"])

    return count


def _block_scores(block: DataFrame, k: int, alpha: float, epsilon: float, mean: np.ndarray, covariance: np.ndarray, of_pop):
    """The function that gives batches of (user, profile, seen) their k best of one block of the catalogue."""
    t = block.orderBy("vec_id").toArrow()
    ids, matrix = np.asarray(t.column("vec_id"), np.int64), as_matrix(t.column("embedding")).reshape(-1, len(mean))
    zpop = (np.asarray(t.column("pop"), np.float64) - of_pop.mean) / (of_pop.deviation + epsilon)
    may = np.asarray(t.column("may").to_pylist(), bool)
    shared = block.sparkSession.sparkContext.broadcast((ids, matrix, zpop, may, mean, covariance))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, zpop, may, mean, covariance = shared.value
        if not len(ids):
            return
        place = {int(i): k for k, i in enumerate(ids)}
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                p = as_matrix(b.column(1))
                deviation = np.sqrt(np.maximum(((p @ covariance) * p).sum(1, keepdims=True), 0.0))
                z = (p @ matrix.T - (p @ mean)[:, None]) / (deviation + epsilon)
                total = np.round((1 - alpha) * zpop[None, :] + alpha * z, 9)
                total[:, ~may] = -np.inf
                for r, gone in enumerate(b.column(2).to_pylist()):
                    for v in gone or ():
                        if v in place:
                            total[r, place[v]] = -np.inf
                order = best_columns(total, k)  # columns stand in the order of their ids
                best = np.take_along_axis(total, order, 1)
                keep = np.isfinite(best).ravel()
                user = np.repeat(np.asarray(b.column(0)), order.shape[1])[keep]
                rank = np.tile(np.arange(1, order.shape[1] + 1), b.num_rows)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(user), pa.array(rank.astype(np.int32)), pa.array(ids[order].ravel()[keep]), pa.array(best.ravel()[keep])], ["user", "rank", "vec_id", "score"])

    return score


def rerank_by_weights(candidates: DataFrame, top: int, weights: Sequence[float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """(query_id, rank, vec_id, final, retrieval_rank): weighted similarity, rating out of 5 and popularity.

    candidates: (query_id, retrieval_rank, vec_id, score, rating, popularity), hard constraints already applied; popularity
    is scaled over all of a query's candidates, equal ones to 0, and the similarity stays as it is.
    """
    p = min_max(F.col("popularity"), ["query_id"], 0.0)
    rating = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("rating"), F.lit(0.0)) / 5))
    final = candidates.withColumn("final", F.round(weights[0] * F.col("score") + weights[1] * rating + weights[2] * p, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("score"), "retrieval_rank", "vec_id")
    ranked = final.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "final", "retrieval_rank")


def rerank(candidates: DataFrame, top: int, pool: int, weights: Sequence[float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """(query_id, rank, vec_id, final, retrieval_rank, change): relevance first.

    candidates: (query_id, retrieval_rank, vec_id, score, rating, popularity). The pool is the first so many of a query in
    retrieval order; similarity and popularity are scaled within it (equal ones to 1 and 0), the rating is out of 5.
    """
    w = Window.partitionBy("query_id").orderBy("retrieval_rank")
    pooled = candidates.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= pool)
    s, p = min_max(F.col("score"), ["query_id"], 1.0), min_max(F.col("popularity"), ["query_id"], 0.0)
    rating = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("rating"), F.lit(0.0)) / 5))
    final = pooled.withColumn("final", F.round(weights[0] * s + weights[1] * rating + weights[2] * p, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("score"), "retrieval_rank", "vec_id")
    ranked = final.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "final", "retrieval_rank", (F.col("retrieval_rank") - F.col("rank")).alias("change"))

"""Exact vector search, norms and profiles over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.operators.interactions import global_rank
from wickerloom.operators.ranking import top_per_group
from wickerloom.session import materialise

#: Bytes of the query vectors that one block holds; a block travels to every partition of the other side.
BLOCK_BYTES = 64 << 20
#: Rows of the searched side that one product takes, and scores that it makes.
ROW_BLOCK = 4096
SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def norm_statistics(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(norm(v).alias("l"), bad.alias("bad"), F.size(v).cast("long").alias("d"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("l"), 5).alias("least"), F.round(F.avg("l"), 5).alias("mean"), F.round(F.max("l"), 5).alias("most"),
        F.count_if("bad").alias("n_not_finite"), F.count_if(F.col("l") == 0).alias("n_zero"), F.min("d").alias("least_dimension"), F.max("d").alias("most_dimension"),
    )


def best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest, largest first, equal ones by place."""
    n = score.shape[1]
    if n <= 4 * k:
        return np.argsort(-score, axis=1, kind="stable")[:, :k]
    cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(score), k), np.int64)
    for r, row in enumerate(score):
        at = np.flatnonzero(row >= cut[r])  # the k best and all that equal the last of them, by place
        out[r] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact inner-product top k per query, ties by vec_id.

    queries: (query_id, embedding); vectors: (vec_id, embedding), of which candidates (vec_id) are left over before
    anything is scored; no candidates, no result. Queries are taken in blocks of BLOCK_BYTES: a block is broadcast as one
    matrix of bounded size, each task keeps its k best per query, and only those are shuffled. Vectors are read once a block.
    """
    if candidates is not None:
        vectors = vectors.join(candidates.select("vec_id").distinct(), "vec_id", "left_semi")
    spark, out = queries.sparkSession, None
    rows = queries.select("query_id", "embedding").filter("embedding is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    # a block is the rows of a hash, so it may exceed its share a little
    blocks = max(1, -(-size.n * (size.d or 0) * 8 // BLOCK_BYTES))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = _block_topk(spark, block.toArrow(), vectors, k)
        out = found if out is None else out.unionByName(found)
    # each task's winners: at most k a query and task
    best = top_per_group(out, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return best.select("query_id", "rank", "vec_id", "score")


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as doubles, without a Python list between."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _block_topk(spark, block: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast((np.asarray(block.column("query_id"), np.int64), as_matrix(block.column("embedding"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        if not len(qid):
            return
        best_score, best_id = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            for a in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(a, ROW_BLOCK)
                own = np.asarray(part.column(0))
                by_id = np.argsort(own, kind="stable")  # ties go to the smaller id, so columns are put in that order first
                x, own = as_matrix(part.column(1))[by_id], own[by_id]
                step = max(1, SCORES // len(own))
                for f in range(0, len(qid), step):
                    score = q[f : f + step] @ x.T
                    order = best_columns(score, k)
                    score = np.hstack([best_score[f : f + step], np.take_along_axis(score, order, 1)])
                    vec = np.hstack([best_id[f : f + step], own[order]])
                    order = np.lexsort((vec, -score))[:, :k]  # twice k columns at most
                    best_score[f : f + step], best_id[f : f + step] = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)
        for f in range(0, len(qid), 10_000):
            s, v = best_score[f : f + 10_000], best_id[f : f + 10_000]
            some = np.isfinite(s).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[f : f + 10_000], k)[some]), pa.array(v.ravel()[some]), pa.array(s.ravel()[some])], ["query_id", "vec_id", "score"])

    rows = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(search, "query_id long, vec_id long, score double")


#: Bytes of the vectors, as floats, that one block of topk_by_length holds; a block travels to every task.
LENGTH_BLOCK_BYTES = 16 << 20
#: Vectors of a block that are scored first; each time after four times as many, ROW_BLOCK at most.
FIRST_ROWS = 256
#: Scores that one product of topk_by_length makes, as ties may leave all of them to be sorted.
PAIRS = 1_000_000
#: Part of two lengths' product that bounds what rounding does to a score and to the bound of the scores to come.
ROUNDING = 1e-6


def topk_by_length(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): exact inner-product top k of each query over vectors of floats, where both sides are large.

    Scores are summed in doubles and rounded to floats; ties by vec_id. No score exceeds the product of both lengths, so
    vectors are scored longest first, and a query is done once its length times the next vector's is below its k-th score.
    Vectors travel in blocks of LENGTH_BLOCK_BYTES; queries that a block leaves open go on to the next, to the last if need be.
    """
    floats = F.col("embedding").cast("array<float>").alias("embedding")
    rows = vectors.filter("embedding is not null").select("vec_id", floats).withColumn("__l", norm(F.col("embedding")))
    placed = global_rank(rows.filter(~F.isnan("__l") & (F.col("__l") < float("inf"))), F.desc("__l"), "vec_id", name="__place")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    step = max(k, LENGTH_BLOCK_BYTES // (4 * (size.d or 1)))
    none = [F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("scores")]
    going, out = queries.filter("embedding is not null").select("query_id", floats, *none), None
    for start in range(0, max(1, size.n), step):
        last = start + step >= size.n
        # one row more tells the length that comes next
        block = placed.filter((F.col("__place") > start) & (F.col("__place") <= start + step + 1)).select("vec_id", "embedding", "__place")
        state = _longest_first(going, block.toArrow(), k, last)
        if not last:
            state = materialise(state, "topk")
        found = state.filter("embedding is null").select("query_id", "ids", "scores")
        out = found if out is None else out.unionByName(found)
        going = state.filter("embedding is not null")
        if not last and going.isEmpty():
            break
    best = out.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "x"))
    return best.select("query_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _padded(column: pa.Array, k: int, fill: np.ndarray) -> np.ndarray:
    """Rows of a list column of k values at most, filled up."""
    out = np.full((len(column), k), fill)
    out[np.arange(k) < np.asarray(column.value_lengths())[:, None]] = np.asarray(column.flatten())
    return out


def _longest_first(queries: DataFrame, block: pa.Table, k: int, last: bool) -> DataFrame:
    """queries with their best of the block and of those before it; the embedding is null where no later vector can be among them."""
    order = np.argsort(np.asarray(block.column(2)))
    own, x = np.asarray(block.column(0), np.int64)[order], as_matrix(block.column(1))[order]
    length = np.append(np.sqrt((x * x).sum(1)), 0.0)
    held = len(own) if last else len(own) - 1
    shared = queries.sparkSession.sparkContext.broadcast((own[:held], x[:held].astype(np.float32), length))

    def fold(q: np.ndarray, reach: np.ndarray, y: np.ndarray, ids: np.ndarray, best_score: np.ndarray, best_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries whose best change, and these."""
        score, cut = q @ y.T, best_score[:, -1].astype(np.float64)
        if len(ids) > k and np.isneginf(cut).any():
            cut = np.maximum(cut, -np.partition(-score, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(score >= (cut - ROUNDING * reach)[:, None])
        # summed again in one order, as a product's last bit depends on where in the matrix it stands
        exact = np.zeros(len(r))
        for d in range(q.shape[1]):
            exact += q[r, d] * y[c, d]
        rows, r = np.unique(r, return_inverse=True)
        r = np.concatenate([r, np.repeat(np.arange(len(rows)), k)])
        s, i = np.concatenate([exact.astype(np.float32), best_score[rows].ravel()]), np.concatenate([ids[c], best_id[rows].ravel()])
        order = np.lexsort((i, -s, r))
        first = np.searchsorted(r[order], np.arange(len(rows)))
        kept = order[(first[:, None] + np.arange(k)).ravel()]  # each has k at least, as its earlier best are among them
        return rows, s[kept].reshape(-1, k), i[kept].reshape(-1, k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, length = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(a, ROW_BLOCK)
                q = as_matrix(part.column(1))
                reach = np.sqrt((q * q).sum(1))
                best_id, best_score = _padded(part.column(2), k, np.iinfo(np.int64).max), _padded(part.column(3), k, np.float32(-np.inf))
                live, at, width = np.arange(len(q)), 0, FIRST_ROWS
                while at < len(ids) and len(live):
                    y, own = x[at : at + width].astype(np.float64), ids[at : at + width]
                    for f in range(0, len(live), PAIRS // width):
                        r = live[f : f + PAIRS // width]
                        rows, s, i = fold(q[r], reach[r] * length[at], y, own, best_score[r], best_id[r])
                        best_score[r[rows]], best_id[r[rows]] = s, i
                    at += len(own)
                    live = live[~(reach[live] * length[at] * (1 + ROUNDING) < best_score[live, -1])]
                    width = min(4 * width, ROW_BLOCK)
                done = np.ones(len(q), bool)
                done[[] if last else live] = False
                some = np.isfinite(best_score)
                offsets = pa.array(np.append(0, np.cumsum(some.sum(1))).astype(np.int32))
                vectors = part.column(1).take(pa.array(np.arange(len(q)), mask=done))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, pa.ListArray.from_arrays(offsets, pa.array(best_id[some])), pa.ListArray.from_arrays(offsets, pa.array(best_score[some]))], ["query_id", "embedding", "ids", "scores"])

    return queries.mapInArrow(search, queries.schema)


def topk_per_candidate(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, group: str, k: int) -> DataFrame:
    """(query_id, group, rank, vec_id, score): of each query's candidate groups, the k best vectors of each.

    candidates: distinct (query_id, group). Only vectors of a query's own candidates are scored.
    """
    pairs = candidates.join(vectors.select(group, "vec_id", "embedding"), group).join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
    scored = pairs.select("query_id", group, "vec_id", dot(F.col("__q"), F.col("embedding")).alias("score"))
    return top_per_group(scored, ["query_id", group], [F.desc("score"), F.col("vec_id")], k).select("query_id", group, "rank", "vec_id", "score")


#: Rows whose sums a task holds before it sends them.
SUM_ROWS = 100_000


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, profile, n): the element-wise mean of each key's vectors at length 1; null keys and vectors don't count.

    Tasks sum the rows of a key that they hold together, so what is shuffled is one vector a key and task at most, and a
    key with many rows is no task's alone.
    """
    kind = T.StructType([rows.schema[key], T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def summed(table: pa.Table) -> pa.RecordBatch:
        code = table.column(0).combine_chunks().dictionary_encode()
        at = np.asarray(code.indices)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        x = as_matrix(table.column(1))[order]
        s, n = np.add.reduceat(x, starts, 0), np.add.reduceat(np.asarray(table.column(2))[order], starts)
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at[order][starts])), pa.array([*s]), pa.array(n)], [key, "s", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= SUM_ROWS:
                yield summed(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield summed(pa.Table.from_batches(held))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            one = summed(pa.Table.from_batches([b] if carry is None else [carry.cast(b.schema), b]))
            # rows come by key, so only the last one may go on
            last = pa.scalar(b.column(0)[-1].as_py(), one.schema.field(0).type)
            at = one.column(0).index(last).as_py() if hasattr(one.column(0), "index") else one.num_rows - 1
            keep = np.arange(one.num_rows) != at
            yield one.filter(pa.array(keep))
            carry = one.slice(at, 1)
        if carry is not None:
            yield carry

    valid = rows.select(key, F.col(vector).cast("array<double>").alias("s"), F.lit(1).cast("long").alias("n")).filter(F.col(key).isNotNull() & F.col("s").isNotNull())
    sums = valid.mapInArrow(partial, kind).repartition(key).sortWithinPartitions(key).mapInArrow(whole, kind)
    mean = F.transform("s", lambda x: x / F.col("n"))
    return sums.select(key, normalised(mean).alias("profile"), "n")


def label_neighbours(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Share of each query's neighbours with its own label."""
    labels = vectors.select("vec_id", "label")
    joined = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return joined.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("purity"))

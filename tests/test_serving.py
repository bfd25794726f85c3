"""Serving set, profiles and searches beyond one block, against loops."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.functions.tokens import encoding, within_budget
from wickerloom.operators import hybrid as H
from wickerloom.operators import interactions as I
from wickerloom.operators import ranking as R
from wickerloom.operators import serving as S
from wickerloom.operators import text as X
from wickerloom.operators import vectors as V

CATALOGUE = "item_index int, parent_asin string, title string, price double, categories array<string>, features array<string>, extra string"


def catalogue(spark, rows):
    return spark.createDataFrame([(i, p, t, price, [" A ", None, ""], ["x  y"], "") for i, p, t, price in rows], CATALOGUE)


def test_canonical_catalogue_is_in_item_order(spark):
    c = catalogue(spark, [(7, " b ", "  T   t ", float("nan")), (3, "a", "", -1.0), (9, "c", None, 5.0)])
    got = sorted(map(tuple, S.canonical_catalogue(c, c.select("item_index")).collect()), key=lambda r: r[-1])
    assert got == [(3, "a", None, None, ["A"], ["x y"], 0), (7, "b", "T t", None, ["A"], ["x y"], 1), (9, "c", None, 5.0, ["A"], ["x y"], 2)]


@pytest.mark.parametrize("rows, canonical, said", [
    ([(1, "a", "", 1.0), (1, "b", "", 1.0)], [1], "item_index 1 stands 2 times"), ([(1, "a", "", 1.0), (2, "a ", "", 1.0)], [1, 2], "parent_asin a stands 2 times"), ([(1, "a", "", 1.0)], [1, 2], "2 is missing"),
    ([(1, "a", "", 1.0), (2, "b", "", 1.0)], [1], "2 is not canonical"), ([(-1, "a", "", 1.0)], [1], "1 invalid items"), ([(1, " ", "", 1.0)], [1], "1 invalid parents"), ([(None, None, "", 1.0)], [1], "1 invalid items and 1 invalid"),
])
def test_a_catalogue_that_does_not_match_fails(spark, rows, canonical, said):
    with pytest.raises(ValueError, match=said):
        S.canonical_catalogue(catalogue(spark, rows), spark.createDataFrame([(i,) for i in canonical], "item_index int"))


def test_lookups_are_checked(spark):
    df = spark.createDataFrame([("b", 1), ("Z", 0), ("é", 2)], "k string, v int")
    good = S.sorted_lookup(df.repartition(3), "k", "v")
    assert [(r.position, r.k) for r in sorted(good.collect())] == [(0, "Z"), (1, "b"), (2, "é")]
    assert tuple(S.lookup_checks(good, "k", "v").first()) == (3, 0, True, True)
    bad = spark.createDataFrame([(0, "b", 0), (1, "a", 1), (2, "a", 3)], "position long, k string, v int")
    assert tuple(S.lookup_checks(bad, "k", "v").first()) == (3, 2, True, False)
    with pytest.raises(ValueError, match="k b stands 2 times"):
        S.sorted_lookup(df.unionByName(df.filter("v = 1")), "k", "v")


def test_schemas_and_reports(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b long")
    assert S.checked_schema(df, T.StructType([T.StructField("b", T.LongType())])).columns == ["b"]
    for name, kind in (("a", T.LongType()), ("c", T.LongType())):
        with pytest.raises(TypeError, match=name):
            S.checked_schema(df, T.StructType([T.StructField(name, kind)]))
    lines = spark.createDataFrame([("# Recall@10",), ("| Recall@10 | 0.5 |",), ("| NDCG@20 | 0.25 | x |",), ("| Loss | 1 |",), (None,)], "line string")
    read = S.read_report(lines)
    assert sorted(map(tuple, read.collect())) == [("NDCG", 20, 0.25), ("Recall", 10, 0.5)]
    base = spark.createDataFrame([("Recall", 10, 0.4), ("NDCG", 20, 0.0)], "metric string, k int, value double")
    assert {r.metric: (r.delta, r.percent) for r in S.metric_deltas(read, base).collect()} == {"Recall": (0.1, 25.0), "NDCG": (0.25, None)}
    guards = S.ranking_guards(spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 2, 7)], "user int, rank int, item int"), spark.createDataFrame([(1, 5)], "user int, item int"), (10, 10, 0))
    assert tuple(guards.first()) == (2, 2, 1, 1, 1)


def test_safe_json(spark):
    df = spark.createDataFrame([(1, float("nan"), ["a", None]), (2, float("inf"), None)], "i int, x double, l array<string>")
    assert [r[0] for r in df.orderBy("i").select(S.safe_json(df, ["i", "x", "l"])).collect()] == ['{"i":1,"x":null,"l":["a",null]}', '{"i":2,"x":null,"l":null}']


def test_positions_are_matched(spark):
    a, b = (spark.createDataFrame([(k + 1, x) for k, x in enumerate(t)], "position int, x string") for t in ("abc", "axcd"))
    assert [tuple(r) for r in sorted(S.positional(a, b, "x").collect())] == [(1, "a", "a", True), (2, "b", "x", False), (3, "c", "c", True), (4, None, "d", False)]


def test_text_pieces(spark):
    df = spark.createDataFrame([("Best A+B (c) shop, a+b (C)", "a+b (c)"), ("plain", ""), ("none", None), (None, "x")], "t string, s string")
    assert [r[0] for r in df.select(X.without_identifier(F.col("t"), F.col("s"))).collect()] == ["Best   shop,  ", "plain", "none", None]
    f = spark.createDataFrame([(["One ;", None, "one", " two", "three", "four"],), ([" - "],), (None,), ([" ".join(f"w{k}" for k in range(50))],)], "f array<string>")
    got = [r[0] for r in f.select(X.feature_query(F.col("f"))).collect()]
    assert got[:3] == ["Looking for a product with these features: One ; two ; three", None, None] and got[3].endswith(" w35")
    long = "supports " + "x" * 1_000_500
    assert spark.createDataFrame([(long,)], "t string").select(F.length(X.without_prefix(F.col("t"), ["supports"]))).first()[0] == 1_000_500


def test_token_budget(spark):
    df = spark.createDataFrame([(1, "Title: a cable", None, "word " * 500), (2, "", None, ""), (3, "é" * 50, "ü" * 50, "x"), (4, "a b c", "d", "e")], "i int, a string, b string, c string")
    got = {r.i: r for r in within_budget(df, ["i"], ["a", "b", "c"], 40).collect()}
    count = lambda t: len(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(t))
    assert all(r.n_tokens == count(r.text) <= 40 for r in got.values())
    assert got[1].cut and got[1].n_tokens >= 38 and got[1].text.startswith("Title: a cable\nword word") and (got[2].text, got[2].cut) == ("", False)
    assert got[3].cut and ("é" * 50 + "\n" + "ü" * 50).startswith(got[3].text) and (got[4].text, got[4].cut) == ("a b c\nd\ne", False)


def some_vectors(seed, n, d=6):
    dice = random.Random(seed)
    return [(k, [dice.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(d)]) for k in range(n)]


def test_vectors_beyond_one_block(spark, monkeypatch):
    q, v = some_vectors(1, 37), some_vectors(2, 90)
    schema = "{} long, embedding array<double>"
    args = spark.createDataFrame(q, schema.format("query_id")), spark.createDataFrame(v, schema.format("vec_id")).repartition(3)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, r + 1, k) for i, a in q for r, (_, k) in enumerate(sorted((-dot(a, b), k) for k, b in v)[:7])}
    for size, scores in ((V.BLOCK_BYTES, V.SCORES), (1000, 200)):
        monkeypatch.setattr(V, "BLOCK_BYTES", size)
        monkeypatch.setattr(V, "SCORES", scores)
        assert {(r.query_id, r.rank, r.vec_id) for r in V.vector_topk(*args, 7).collect()} == want


def test_profiles_of_a_hot_user_are_sums_of_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "SUM_ROWS", 50)
    dice = random.Random(3)
    rows = [(dice.choice([1] * 8 + [2, 3, None]), v if dice.random() < 0.9 else None) for _, v in some_vectors(4, 700, 3)]
    got = {r.u: r for r in V.mean_vectors(spark.createDataFrame(rows, "u int, embedding array<double>").repartition(5), "u").collect()}
    by = defaultdict(list)
    for u, v in rows:
        if u is not None and v is not None:
            by[u].append(v)
    assert got.keys() == by.keys()
    for u, vs in by.items():
        mean = [sum(x) / len(vs) for x in zip(*vs)]
        length = math.sqrt(sum(x * x for x in mean))
        assert got[u].n == len(vs) and got[u].profile == pytest.approx([x / length for x in mean], abs=1e-9)


@pytest.mark.parametrize("block", [65_536, 7])
def test_target_ranks_and_eligible_lists_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(H, "MAX_CATALOGUE", block)
    vectors, users = some_vectors(5, 30, 4), [(u, [x + 0.1 * u for x in v]) for u, v in some_vectors(6, 12, 4)]
    pop = {k: k % 4 for k in range(30) if k % 4}
    dice = random.Random(7)
    targets = [(u, dice.randrange(30)) for u, _ in users]
    seen = {(u, dice.randrange(30)) for u, _ in users for _ in range(4)} | {(0, targets[0][1])}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    p, v = frame(users, "user long, profile array<double>"), frame(vectors, "vec_id long, embedding array<double>")
    counts, sn = frame([*pop.items()], "vec_id long, n long"), frame([*seen], "user long, vec_id long")

    def z(values):
        mean = sum(values) / len(values)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))
        return [(x - mean) / (deviation + 1e-6) for x in values]

    zp = z([pop.get(k, 0) for k in range(30)])
    zs = {u: z([sum(a * b for a, b in zip(x, y)) for _, y in vectors]) for u, x in users}

    def total(u, k, variant, alpha):
        return round(zs[u][k] if variant == "cold_aware" and k not in pop else (1 - alpha) * zp[k] + alpha * zs[u][k], 9)

    got = {(r.user, r.variant, r.alpha): r["rank"] for r in H.target_ranks(p, v, counts, frame(targets, "user long, vec_id long"), (0.0, 0.5, 1.0), sn).collect()}
    for u, t in targets:
        for variant in ("uniform", "cold_aware"):
            for alpha in (0.0, 0.5, 1.0):
                order = sorted((k for k in range(30) if (u, k) not in seen), key=lambda k: (-total(u, k, variant, alpha), k))
                assert got[u, variant, alpha] == (order.index(t) + 1 if t in order else 0)
    pairs = [(u, k) for u, _ in users for k in (0, 7, 29)] + [(99, 1), (0, 99)]
    z_of = {(r.user, r.vec_id): r.z for r in H.pair_z_scores(frame(pairs, "user long, vec_id long"), p, v).collect()}
    assert z_of == {(u, k): pytest.approx(zs[u][k], abs=1e-9) for u, k in pairs if u != 99 and k != 99}
    eligible = [k for k in range(30) if k % 3]
    lists = defaultdict(list)
    for r in sorted(H.profile_scores(p, v, 5, counts, 0.5, sn, eligible=frame([(k,) for k in eligible], "vec_id long")).collect(), key=lambda r: r["rank"]):
        lists[r.user].append(r.vec_id)
    for u, _ in users:
        assert lists[u] == sorted((k for k in eligible if (u, k) not in seen), key=lambda k: (-total(u, k, "uniform", 0.5), k))[:5]


def test_popular_lists_beyond_the_near_ranks(spark, monkeypatch):
    monkeypatch.setattr(R, "NEAR_RANKS", 3)
    rows = [(u, i) for i in range(12) for u in range(30 - i)]
    train = spark.createDataFrame([(u, i) for u, i in rows if u % 5 < 3], "user int, item int")
    pop = R.popularity(train)
    users = spark.createDataFrame([(u,) for u in range(35)], "user int")
    order = [r.item for r in sorted(pop.collect(), key=lambda r: r.pop_rank)]
    seen = {(r.user, r.item) for r in train.collect()}
    want = {(u, k + 1, i) for u in range(35) for k, i in enumerate([i for i in order if (u, i) not in seen][:4])}
    assert {tuple(r) for r in R.popularity_topk(train, users, pop, 4).collect()} == want


def test_split_of_long_and_short_histories(spark):
    rows = [(u, i, (i * 7) % 5) for u, n in ((1, 1), (2, 2), (3, 3), (4, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "user int, item int, ts int").repartition(4)
    got = {(r.user, r.item): r.split for r in I.temporal_split(df).collect()}
    for u in (1, 2, 3, 4):
        mine = sorted((ts, i) for x, i, ts in rows if x == u)
        want = {i: "train" for _, i in mine}
        if len(mine) > 2:
            want[mine[-1][1]], want[mine[-2][1]] = "test", "valid"
        assert {i: s for (x, i), s in got.items() if x == u} == want


def best_by_loop(queries, vectors, k):
    """{(query, rank, vector, score)} with every pair scored; scores rounded to floats, ties by vector."""
    import numpy as np

    out = set()
    for q, a in queries:
        scores = [(-float(np.float32(sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b)))), v) for v, b in vectors]
        out |= {(q, r + 1, v, -s) for r, (s, v) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("shape", ["long tail", "one length", "few values"])
def test_search_by_length_equals_every_pair(spark, monkeypatch, shape):
    import numpy as np

    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(400, 6)), rng.normal(size=(50, 6))
    if shape == "long tail":
        x /= (1 + np.arange(400))[:, None]
    elif shape == "one length":
        x /= np.sqrt((x * x).sum(1))[:, None]
    else:  # many ties, also between vectors of one length whose squares are summed in another order
        x, q = rng.integers(-1, 2, size=(400, 6)) * 0.1, rng.integers(-1, 2, size=(50, 6)) * 1.0
    q[3] = 0
    x[17] = 0
    vectors = [(int(v), x[v].tolist()) for v in rng.permutation(400)]
    queries = [(k, a.tolist()) for k, a in enumerate(q)]
    v = spark.createDataFrame([*vectors, (400, None), (401, [float("nan")] * 6)], "vec_id int, embedding array<float>")
    d = spark.createDataFrame([*queries, (50, None)], "query_id int, embedding array<float>")
    want = best_by_loop(queries, vectors, 7)
    for size, first in ((V.LENGTH_BLOCK_BYTES, V.FIRST_ROWS), (150 * 24, 5)):  # in one block and in three
        monkeypatch.setattr(V, "LENGTH_BLOCK_BYTES", size)
        monkeypatch.setattr(V, "FIRST_ROWS", first)
        assert {tuple(r) for r in V.topk_by_length(d, v, 7).collect()} == want
    assert V.topk_by_length(d, v.filter("false"), 7).collect() == [] and V.topk_by_length(d.filter("false"), v, 7).collect() == []
    assert {tuple(r) for r in V.topk_by_length(d, v.filter("vec_id < 3"), 7).collect()} == best_by_loop(queries, [p for p in vectors if p[0] < 3], 7)


def test_search_by_length_ends_before_the_long_tail(spark, monkeypatch):
    v = spark.createDataFrame([(v, [1.0 / (1 + v), 0.0]) for v in range(2000)], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(k, [1.0 + k, 1.0]) for k in range(5)], "query_id int, embedding array<float>")
    blocks, real = [], V._longest_first
    monkeypatch.setattr(V, "_longest_first", lambda queries, block, *rest: blocks.append(block.num_rows) or real(queries, block, *rest))
    monkeypatch.setattr(V, "LENGTH_BLOCK_BYTES", 100 * 8)
    assert {(r.query_id, r.rank, r.vec_id) for r in V.topk_by_length(q, v, 3).collect()} == {(k, r + 1, r) for k in range(5) for r in range(3)}
    assert blocks == [101]


def test_factorised_lists_are_whole_without_scoring_every_pair(spark, tmp_path, monkeypatch):
    from pyspark.ml.recommendation import ALSModel

    from wickerloom.plans.documents import factorised_topk

    rng, seen = random.Random(4), []
    rows = [(u, i) for u in range(40) for i in {*rng.sample(range(60), 4), rng.choice([0, 1, 2])}] + [(-1, 5), (0, 1), (0, 1)]
    spark.createDataFrame(rows, "user_indices int, item_indices int").write.parquet(f"{tmp_path}/train.parquet")
    monkeypatch.setattr(ALSModel, "recommendForAllUsers", lambda *a: pytest.fail("every user is scored with every item"))
    real = V.topk_by_length
    monkeypatch.setattr(V, "topk_by_length", lambda users, items, k: seen.extend(([tuple(r) for r in users.collect()], [tuple(r) for r in items.collect()])) or real(users, items, k))
    got = factorised_topk(spark, str(tmp_path))
    assert got.dtypes == [("user_indices", "int"), ("rank", "int"), ("item_indices", "int"), ("rating", "float")]
    assert {tuple(r) for r in got.select("user_indices", "rank", "item_indices", "rating").collect()} == best_by_loop(*seen, 10)
    assert got.count() == 400 and {u for u, _ in seen[0]} == {*range(40)}

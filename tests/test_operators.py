"""Core operators on small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from wickerloom.operators import catalogue as C
from wickerloom.operators import hybrid as H
from wickerloom.operators import interactions as I
from wickerloom.operators import profiling as P
from wickerloom.operators import ranking as R
from wickerloom.operators import text as X
from wickerloom.operators import vectors as V


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        (10, [" Electronics ", "Docking   Stations"], ["Supports HDMI output and USB-C power delivery"], 99.0),
        (20, ["Electronics", "Docking Stations"], ["HDMI video output", "Gigabit Ethernet", None], None),
        (40, ["Electronics", "Computer Mice"], [], float("nan")),
        (70, ["Electronics", "Headphones"], ["Active noise cancelling with long battery life"], 50.0),
        (90, ["Electronics", "Docking Stations"], ["HDMI output only"], 150.0),
        (95, None, None, 100.0),
    ]
    return spark.createDataFrame(rows, "item int, categories array<string>, features array<string>, price double")


def items(df):
    return sorted(r.item for r in df.collect())


@pytest.mark.parametrize("name, want", [(" docking stations ", [10, 20, 90]), ("Docking Station", []), ("mouse", [])])
def test_category(shop, name, want):
    assert items(shop.filter(C.in_category(F.col("categories"), name))) == want


@pytest.mark.parametrize("wanted, want", [(["HDMI", "USB-C"], [10]), (["HDMI", "Ethernet"], [20]), (["usb-c"], [10]), (["USB"], []), (["noise   cancelling"], [70]), (["hdmi output"], [10, 90]), (["!"], []), ([], [10, 20, 40, 70, 90, 95])])
def test_features(shop, wanted, want):
    got = items(shop.filter(C.has_features(F.col("features"), wanted)))
    assert got == (want if wanted else items(shop))


def test_bounds_and_index(shop):
    assert items(shop.filter(C.within("price", most=100))) == [10, 70, 95]
    index = C.inverted_index(shop, "item", "features")
    assert items(C.having_all_tokens(index, "item", ["hdmi", "output", "hdmi"])) == [10, 20, 90]


def test_core_peels_in_rounds(spark):
    rows = [(u, i, 0) for u in range(3) for i in range(3)] + [(3, 0, 0), (3, 9, 0), (4, 9, 0), (None, 1, 0)]
    got = I.kcore(spark.createDataFrame(rows, "user long, item long, ts long"), 3)
    assert sorted((r.user, r.item) for r in got.collect()) == [(u, i) for u in range(3) for i in range(3)]
    assert I.kcore(got.filter("false"), 3).collect() == []


def test_split_takes_the_last_two(spark):
    rows = [(1, 5, 10), (1, 6, 10), (1, 7, 9), (2, 1, 1), (2, 2, 2)]
    got = {(r.user, r.item): r.split for r in I.temporal_split(spark.createDataFrame(rows, "user long, item long, ts long")).collect()}
    assert got == {(1, 6): "test", (1, 5): "valid", (1, 7): "train", (2, 1): "train", (2, 2): "train"}


def test_global_rank_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert [(r.x, r.rank) for r in I.global_rank(df, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]


def test_target_ranks_give_metrics(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "user int, rank int")
    got = {r.k: (r.recall, r.ndcg) for r in R.loo_metrics(df, (1, 2, 4)).collect()}
    g = [1 / math.log2(r + 1) for r in (1, 2, 3)]
    assert got == {1: (0.25, 0.25), 2: (0.5, round(sum(g[:2]) / 4, 8)), 4: (0.75, round(sum(g) / 4, 8))}


def test_every_user_of_the_truth_counts(spark):
    ranking = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "user int, rank int, item int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 10)], "user int, item int")
    r = R.rank_metrics(ranking, truth, [2]).first()
    assert (r.n_users, r.recall) == (2, 0.25)
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, abs=1e-7)


def test_scaling_of_equal_values(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "q int, s double")
    got = df.select("q", R.min_max(F.col("s"), ["q"], 1.0).alias("m")).collect()
    assert sorted(map(tuple, got)) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_vector_search_breaks_ties_by_id_and_keeps_to_candidates(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (9, None)], "query_id long, embedding array<float>")
    assert [r.vec_id for r in V.vector_topk(q, v, 3).orderBy("rank").collect()] == [2, 3, 1]
    few = spark.createDataFrame([(1,), (3,)], "vec_id long")
    assert [r.vec_id for r in V.vector_topk(q, v, 3, few).orderBy("rank").collect()] == [3, 1]
    assert V.vector_topk(q, v, 3, few.filter("false")).collect() == []
    assert V.vector_topk(q.filter("false"), v, 3).collect() == []


def test_profiles_have_length_one(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "user long, embedding array<float>")
    got = {r.user: r.profile for r in V.mean_vectors(df, "user").collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] is None


def test_propagation_is_a_weighted_mean(spark):
    g = H.edges(spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "user long, item long"))
    assert sorted((r.src, r.dst, round(r.w, 6)) for r in g.collect()) == [("i1", "u1", 0.707107), ("i2", "u1", 0.707107), ("u1", "i1", 0.707107), ("u1", "i2", 0.707107)]
    x = spark.createDataFrame([("u1", 0, 1.0)], "node string, pos int, x double")
    got = {r.node: round(r.x, 6) for r in H.propagate(g, x, 1).collect()}
    assert got == {"u1": 0.5, "i1": 0.353553, "i2": 0.353553}


@pytest.mark.parametrize(
    "text, want",
    [("Fast   charger See More now", "Fast charger now"), ("a b　c", "a b c"), (None, None), ("  ", "")],
)
def test_cleaning(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.clean_text(F.col("t"))).first()[0] == want


def test_word_packing(spark):
    df = spark.createDataFrame([(1, "aa bb cc dddddddd e"), (2, ""), (3, None)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", X.pack_words(F.col("t"), 5).alias("p")).collect()}
    assert got == {1: ["aa bb", "cc", "dddddddd", "e"], 2: [], 3: None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("supports HDMI output", (True, False)), ("4K HDMI port", (True, False)), ("does not support HDMI", (False, True)), ("doesn't support HDMI", (False, True)), ("not compatible with HDMI", (False, True)),
        ("without HDMI", (False, True)), ("no HDMI port", (False, True)), ("lacks HDMI", (False, True)), ("High quality video output", (False, False)), ("Supports DisplayPort", (False, False)), ("superhdmi port", (False, False)),
        ("supports HDMI but the second model has no HDMI", (True, True)), ("HDMI", (True, False)), ("HDMI output is supported. Power adapter is not included.", (True, False)), ("with a usb hdmi adapter", (False, False)),
        ("lack of HDMI", (False, True)), ("equipped with HDMI", (True, False)), ("supports no HDMI HDMI", (False, True)), (None, (False, False)),
    ],
)
def test_evidence(spark, text, want):
    s, c = X.evidence(F.col("t"), ["HDMI"])
    assert tuple(spark.createDataFrame([(text,)], "t string").select(s, c).first()) == want


@pytest.mark.parametrize("text", ["USB-C", "USB C", "Type-C", "Type C", "supports usb‑c"])
def test_evidence_of_any_alias(spark, text):
    s, c = X.evidence(F.col("t"), ["usb-c", "type-c"])
    assert tuple(spark.createDataFrame([(text,), ("Thunderbolt 3",), ("c++ (a.b)",)], "t string").select(s, c).collect()[0]) == (True, False)
    assert spark.createDataFrame([("c++ port",), ("cc port",)], "t string").select(X.evidence(F.col("t"), ["c++"])[0].alias("s")).collect() == [(True,), (False,)]


def test_rerank_keeps_to_the_pool(spark):
    rows = [(1, r, 100 + r, 1 - r / 10, 5.0 if r == 3 else 1.0, float(r)) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id long, retrieval_rank int, vec_id long, score double, rating double, popularity double")
    got = H.rerank(df, 2, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [101, 102] and all(r.retrieval_rank <= 3 for r in got)


def test_percentiles_interpolate(spark):
    f = spark.createDataFrame([("user", 1, 1), ("user", 2, 2), ("user", 10, 1)], "side string, degree long, n long")
    assert P.degree_percentiles(f, (0.5, 0.9)).first()[1:] == (2.0, 7.6)


def test_product_text_round_trip(spark):
    rows = [(1, "Dock", ["A", " B "], ["x  y", None, ""], "long\n text"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "item_index int, title string, categories array<string>, features array<string>, description string")
    got = {r.item_index: tuple(r)[1:] for r in X.parse_product_text(X.product_text(df)).collect()}
    assert got == {1: ("Dock", ["A", "B"], ["x y"], "long text"), 2: (None, [], [], None)}
    wrapped = spark.createDataFrame([(1, "Title: a\n  b\nCategory: c | d\nother\nDescription:  e ")], "item_index int, text string")
    assert tuple(X.parse_product_text(wrapped).first())[1:] == ("a\nb", ["c", "d\nother"], [], "e")


def test_details_and_prefixes(spark):
    df = spark.createDataFrame([({"a": " x ", "b": "", "skip": "y", "c": "z" * 9},)], "m map<string,string>")
    assert sorted(df.select(X.details_text(F.col("m"), ("skip",), 5)).first()[0].split(" | ")) == ["a: x", "c: zzzzz..."]
    texts = spark.createDataFrame([("must support hdmi",), ("must supporthdmi",), ("支持hdmi",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.without_prefix(F.col("t"), ["must", "must support", "支持"])).collect()] == ["hdmi", "supporthdmi", "hdmi", None]


def test_knowledge_chunks(spark):
    rows = [(1, "P1", "Dock", ["A"], ["f1", None, "f2"], None, 20.5, float("nan"), 3), (2, "P2", None, None, [], "w " * 1500, None, 4.0, None)]
    df = spark.createDataFrame(rows, "item_index int, parent_asin string, title string, categories array<string>, features array<string>, description string, price double, average_rating double, rating_number int")
    got = {r.chunk_id: r.text for r in X.knowledge_chunks(df).collect()}
    assert got["1:summary:0"] == "Title: Dock Categories: A Price: 20.5" and got["1:features:0"] == "f1 f2" and got["2:summary:0"] == "Average rating: 4"
    assert sorted(got) == ["1:features:0", "1:summary:0", "2:description:0", "2:description:1", "2:summary:0"] and max(map(len, got.values())) <= 1600


def test_fingerprint_is_a_tree(spark):
    a = spark.range(50).select("id", F.col("id").cast("string").alias("l"))
    one = lambda df, fan: P.ordered_fingerprint(df, "id", F.col("l"), fan).first()[0]
    assert one(a, 7) == one(a.repartition(5), 7) != one(a.withColumn("l", F.when(F.col("id") == 49, "x").otherwise(F.col("l"))), 7)
    assert P.ordered_fingerprint(a.filter("false"), "id", F.col("l")).collect() == []


def test_a_long_chain_peels_to_nothing(spark, monkeypatch):
    monkeypatch.setattr(I, "materialise", lambda df, label: spark.createDataFrame(df.collect(), df.schema).coalesce(1))
    rows = [(k // 2, (k + 1) // 2) for k in range(208)]  # a path loses its two ends a round
    ring = [(1000, 1000), (1000, 1001), (1001, 1000), (1001, 1001)]
    got = I.kcore(spark.createDataFrame(rows + ring, "user long, item long").coalesce(1), 2)
    assert sorted((r.user, r.item) for r in got.collect()) == ring


def test_hybrid_scores_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v, u = rng.normal(size=(40, 4)), rng.normal(size=(5, 4))
    v[7] = v[3]  # a tie
    vectors = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    profiles = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(u)] + [(9, None)], "user long, profile array<double>")
    seen = spark.createDataFrame([(0, 3), (0, 11), (1, 7)], "user long, vec_id long")
    pop = {i: float(i % 5) for i in range(30)}
    got = {}
    for r in H.profile_scores(profiles, vectors, 6, pop, 0.7, seen).collect():
        got.setdefault(r.user, {})[r.rank] = r.vec_id
    z = lambda x: (x - x.mean()) / (x.std() + 1e-6)
    p = z(np.asarray([pop.get(i, 0.0) for i in range(40)]))
    for k, x in enumerate(u):
        total = np.round(0.3 * p + 0.7 * z(v @ x), 9)
        gone = {(0, 3), (0, 11), (1, 7)}
        want = sorted((i for i in range(40) if (k, i) not in gone), key=lambda i: (-total[i], i))[:6]
        assert [got[k][r] for r in range(1, 7)] == want
    assert 9 not in got


def test_hybrid_scores_are_the_same_in_any_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(2, 1, size=(60, 4)))] + [(60, [1.0] * 4), (61, [1.0] * 4)], "vec_id long, embedding array<double>")
    profiles = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(6, 4)))], "user long, profile array<double>")
    seen = spark.createDataFrame([(0, 3), (0, 11), (1, 60)], "user long, vec_id long")
    pop = {i: float(i % 7) for i in range(0, 62, 3)}
    rows = lambda: [(r.user, r.rank, r.vec_id, round(r.score, 7)) for r in H.profile_scores(profiles, vectors, 50, pop, 0.7, seen).orderBy("user", "rank").collect()]
    whole = rows()
    monkeypatch.setattr(H, "MAX_CATALOGUE", 9)
    assert rows() == whole and len(whole) == 300
    assert H.profile_scores(profiles, vectors.filter("false"), 5).collect() == []


def test_best_columns_take_ties_by_place():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.integers(0, 6, size=(7, 60)).astype(float)
        s[rng.random(s.shape) < 0.1] = -np.inf
        assert (V.best_columns(s, 5) == np.argsort(-s, axis=1, kind="stable")[:, :5]).all()

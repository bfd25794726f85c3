"""Co-occurrence and surviving records against brute force."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wickerloom.llm.cooccurrence import associated, cooccurrence
from wickerloom.llm.queries import QUERIES
from wickerloom.llm.survivors import interaction_survivors

ANY = {"max_examples": 8, "deadline": None, "suppress_health_check": list(HealthCheck)}


def brute(rows, least):
    baskets = defaultdict(set)
    users = {u for u, _ in rows if u is not None and u >= 0}
    for u, i in rows:
        if u in users and i is not None:
            baskets[u].add(i)
    one = Counter(i for b in baskets.values() for i in b)
    two = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b): (n, one[a], one[b], len(users)) for (a, b), n in two.items() if n >= least}


def ours(spark, rows, least, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "u int, i int, n_ab int")
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in cooccurrence(df, "u", "i", least, **options).collect()}


def test_huge_record_is_cut_into_blocks(spark):
    rows = [(1, i) for i in range(300)] + [(2, i) for i in range(0, 300, 2)] + [(u, i) for u in range(3, 40) for i in (u, u + 1, 7)] + [(-1, 1), (-1, 2), (None, 3), (5, None)]
    want = brute(rows, 1)
    assert ours(spark, rows, 1) == want
    assert ours(spark, rows, 1, wide=5, block=40) == want
    assert ours(spark, rows, 2, wide=5, block=40) == brute(rows, 2)


@settings(**ANY)
@given(st.lists(st.tuples(st.sampled_from([-1, 0, 0, 0, 1, 2, None]), st.one_of(st.none(), st.integers(0, 12))), max_size=50))
def test_any_baskets(spark, rows):
    assert ours(spark, rows, 1, wide=3, block=4) == brute(rows, 1)


def test_lift_is_compared_without_rounding(spark):
    rows = [(u, i) for u in range(10) for i in (1, 2)] + [(u, 9) for u in range(10, 30)]
    df = spark.createDataFrame(rows, "u int, i int")
    pairs = cooccurrence(df, "u", "i", 10)
    assert [(r.item_a, r.item_b) for r in associated(pairs, 3).collect()] == [(1, 2)]
    assert associated(pairs, 4).collect() == []


def test_all_pairs_has_the_rare_ones(spark, tmp_path):
    rows = [(u, i) for u in range(12) for i in (1, 2)] + [(3, 9), (20, 9), (20, 8), (-1, 8), (None, 1), (21, 1), (21, 1)]
    spark.createDataFrame(rows, "user_indices int, item_indices int").write.parquet(f"{tmp_path}/train.parquet")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in QUERIES["p3_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == brute(rows, 1) and (8, 9) in got
    assert {(r.item_a, r.item_b) for r in QUERIES["p3_pairs"](spark, str(tmp_path)).collect()} == {(1, 2)}


T0 = datetime(2020, 1, 1)
ROW = "interaction_id long, user_indices int, item_indices int, ratings float, timestamps long, feed string, ingested_at timestamp, __src string"


def feeds(spark):
    return spark.createDataFrame([("app", 50), ("web", 40), ("kiosk", 40), ("dump", 10)], "feed string, trust int")


def expected(rows, least=2):
    trust = {"app": 50, "web": 40, "kiosk": 40, "dump": 10}
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None and r[1] >= 0 and r[2] >= 0:
            groups[r[1], r[2]].append(r)
    out = {}
    for k, own in groups.items():
        if len(own) < least:
            continue
        best = lambda ok: max((r for r in own if ok(r)), key=lambda r: (trust.get((r[5] or "").strip().lower(), 0), r[6] or datetime.min, r[0]), default=[None])[0]  # noqa: B023, E731
        ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
        out[k] = (best(lambda r: r[3] is not None and 1 <= r[3] <= 5), best(lambda r: r[4] is not None and r[6] is not None and 946_684_800_000 <= r[4] <= ms(r[6])))
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROW)
    survivors, _ = interaction_survivors(df, feeds(spark), **options)
    return {(r.user_indices, r.item_indices): (r.rating_from, r.timestamp_from) for r in survivors.collect()}


row = st.tuples(
    st.sampled_from([0, 0, 0, 1, -1, None]), st.sampled_from([0, 0, 1, None]), st.sampled_from([None, 0.0, 1.0, 4.0, 5.0, 52.0]), st.sampled_from([None, 5, 1_500_000_000_000, 1_560_000_000_000, 9_000_000_000_000]),
    st.sampled_from([" App", "WEB", "kiosk ", "dump", "other", None]), st.one_of(st.none(), st.integers(0, 3).map(lambda d: T0 + timedelta(days=d))),
)


@settings(**ANY)
@given(st.lists(row, max_size=25))
def test_survivors_follow_trust_then_recency(spark, rows):
    rows = [(k, *r) for k, r in enumerate(rows)]
    assert got(spark, rows) == expected(rows)


def test_one_pair_with_most_rows_and_repeated_rows(spark):
    rows = [(k % 50, 1, 1, float(k % 7), 1_500_000_000_000 + k, ["web", "kiosk"][k % 2], T0 + timedelta(hours=k % 50)) for k in range(400)]
    assert got(spark, rows) == expected(rows)


def test_consensus_outvotes_a_lone_source(spark):
    rows = []
    for u in range(40):
        for s, feed in enumerate(("web", "kiosk", "dump")):
            rows.append((len(rows), u, 1, 4.0, None, feed, T0))
        rows.append((len(rows), u, 1, 2.0 if u < 35 else 4.0, None, "app", T0))
    df = spark.createDataFrame([(*r, "") for r in rows], ROW)
    survivors, report = interaction_survivors(df, feeds(spark), strict=False)
    assert {r.rating for r in survivors.collect()} == {4.0}
    reliability = {r.source: r.reliability for r in report.filter("field = 'rating'").collect()}
    assert reliability["app"] < 0.6 < 0.9 < reliability["web"]
    # a strict order of trust follows the most trusted source all the same
    assert {r.rating for r in interaction_survivors(df, feeds(spark))[0].filter("user_indices < 35").collect()} == {2.0}


def test_empty_tables(spark):
    assert got(spark, []) == {}
    df = spark.createDataFrame([(1, 1, 1, 3.0, 1_500_000_000_000, "app", T0, ""), (2, 1, 1, 4.0, None, None, T0, "")], ROW)
    s, _ = interaction_survivors(df, feeds(spark).filter("false"))
    assert [(r.rating_from, r.timestamp_from) for r in s.collect()] == [(2, 1)]


def test_sources_are_bounded(spark):
    many = spark.createDataFrame([(f"f{k}", k) for k in range(100)], "feed string, trust int")
    with pytest.raises(ValueError):
        interaction_survivors(spark.createDataFrame([], ROW), many)


def test_consensus_against_a_plain_iteration(spark):
    import math
    import random
    from collections import defaultdict

    from wickerloom.llm.survivors import Field, truth_discovery

    dice = random.Random(11)
    rows = []
    for e in range(300):
        truth = dice.randrange(5)
        for s, good in (("good", 0.9), ("middling", 0.6), ("bad", 0.3)):
            for _ in range(dice.randrange(3)):
                rows.append((e, s, len(rows), truth if dice.random() < good else dice.randrange(5)))
    df = spark.createDataFrame(rows, "e int, s string, at int, v int")
    trust = spark.createDataFrame([("bad", 1), ("good", 3), ("middling", 2)], "s string, t int")
    got, report = truth_discovery(df, ["e"], "s", ["at"], [Field("v", F.col("v"), F.col("v") >= 0)], trust, "s", "t", strict=False)

    number = {"bad": 1, "middling": 2, "good": 3}
    claims = defaultdict(dict)
    for e, s, at, v in rows:
        claims[e][number[s]] = max((at, v), claims[e].get(number[s], (-1, 0)))
    r = dict.fromkeys(number.values(), 0.8)

    def best(of):
        w = {s: math.log(r[s] / (1 - r[s])) for s in r}
        support = defaultdict(float)
        for s, (_, v) in sorted(of.items()):
            support[v] += w[s]
        return max((support[v], w[s], s, v) for s, (_, v) in of.items())[3]

    while True:
        new = {}
        for s in r:
            shared = [c for c in claims.values() if s in c and len(c) > 1]
            new[s] = min(0.99, max(0.51, (sum(c[s][1] == best(c) for c in shared) + 1) / (len(shared) + 2)))
        moved = max(abs(new[s] - r[s]) for s in r)
        r = new
        if moved <= 1e-6:
            break
    assert {x.source: round(x.reliability, 9) for x in report.collect() if x.claims} == {n: round(r[k], 9) for n, k in number.items()}
    assert {x.e: x.v for x in got.collect()} == {e: best(c) for e, c in claims.items()}
    assert r[3] > r[2] > r[1]


def test_as_many_sources_as_held(spark):
    from wickerloom.llm.survivors import MAX_SOURCES, Field, truth_discovery

    df = spark.createDataFrame([(1, "s0", 1, 5)], "e int, s string, at int, v int")
    trust = spark.createDataFrame([(f"s{k}", k) for k in range(MAX_SOURCES)], "s string, t int")
    run = lambda t: truth_discovery(df, ["e"], "s", ["at"], [Field("v", F.col("v"), F.col("v") >= 0)], t, "s", "t")[0].first().v
    assert run(trust) == 5
    with pytest.raises(ValueError):
        run(trust.unionByName(spark.createDataFrame([("one more", 1)], trust.schema)))


@pytest.mark.parametrize("popular, columns, rows, matrix", [(64, 512, 200_000, 8192), (4, 5, 150, 16), (10**9, 3, 40, 7), (0, 512, 60, 8192)])
def test_blocks_of_records_in_any_cut(monkeypatch, popular, columns, rows, matrix):
    import random

    import numpy as np
    import pyarrow as pa

    from wickerloom.llm import cooccurrence as module

    for name, value in (("POPULAR", popular), ("COLUMNS", columns), ("BLOCK_ROWS", rows), ("MATRIX_ROWS", matrix)):
        monkeypatch.setattr(module, name, value)
    dice = random.Random(9)
    baskets = [sorted({min(dice.randrange(40), dice.randrange(40)) for _ in range(dice.randrange(1, 12))}) for _ in range(300)]
    flat = np.array([(r, i) for r, b in enumerate(baskets) for i in b], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["r", "i"]) for x in np.array_split(flat, 23)]
    got = Counter()
    for b in module._gram(iter(batches)):
        for a, z, n in zip(*(c.to_pylist() for c in b.columns)):
            got[a, z] += n
    assert got == Counter(p for b in baskets for p in combinations(b, 2))
    assert list(module._gram(iter([]))) == []

"""One surviving record per group of duplicates by iterative truth discovery.

Sources claim a value for each field of an entity. Rounds alternate between weighted votes (the highest-supported value
of an entity's field wins) and source reliability (how often a source's claims won) until reliability stands still.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerloom.session import materialise

#: The most sources that are told apart; claims of an entity are held in one row of this many at most.
MAX_SOURCES = 64


@dataclass(frozen=True)
class Field:
    """A field to fuse: its value column and the condition under which a row's value is usable."""

    name: str
    value: Column
    usable: Column


def _sources(trust: DataFrame, name: str, level: str, pooled: bool) -> list[tuple[str, int, int]]:
    """(normalised source, its number, trust rank), least trusted first; number 0 is every source that isn't listed.

    pooled: sources of one trust level are one source.
    """
    n = F.lower(F.trim(F.col(name)))
    listed = trust.filter(n.isNotNull() & F.col(level).isNotNull()).groupBy(n.alias("s")).agg(F.max(level).alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; claims of an entity would not stay bounded")
    levels = {t: k + 1 for k, t in enumerate(sorted({r.t for r in listed}))}
    rows = sorted((levels[r.t], r.s) for r in listed)
    return [(s, k if pooled else i + 1, k) for i, (k, s) in enumerate(rows)]


def claims(df: DataFrame, keys: Sequence[str], source: Column, order: Sequence[str], fields: Sequence[Field], n_sources: int, least_rows: int) -> DataFrame:
    """Per entity: n_rows, and for each field an array of (src, value, at), one claim per source that has a usable value.

    A source's claim is its latest: the largest by the order columns. The maxima are combined before the shuffle, so an
    entity with any number of rows sends one row per input split.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in fields:
        # order columns that are null come last, as the smallest
        claim = F.struct(*(F.col(c).alias(f"at{i}") for i, c in enumerate(order)), f.value.alias("value"))
        aggs += [F.max(F.when(f.usable & (F.col("__src") == s), claim)).alias(f"__{f.name}_{s}") for s in range(n_sources)]
    wide = df.withColumn("__src", source).groupBy(*keys).agg(*aggs).filter(F.col("n_rows") >= least_rows)
    out = [*keys, "n_rows"]
    for f in fields:
        each = [
            F.when(F.col(f"__{f.name}_{s}").isNotNull(), F.struct(F.lit(s).alias("src"), F.col(f"__{f.name}_{s}.value").alias("value"), F.col(f"__{f.name}_{s}.at{len(order) - 1}").alias("id")))
            for s in range(n_sources)
        ]
        out.append(F.filter(F.array(*each), lambda c: c.isNotNull()).alias(f.name))
    return wide.select(*out)


def _vote(claims_: Column, weights: Sequence[float]) -> Column:
    """(support, src, value, id) of the claim whose value has the most support; of its claimants the weightiest, then the highest numbered."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    scored = F.transform(
        claims_,
        lambda c: F.struct(
            F.aggregate(F.filter(claims_, lambda o: o["value"] == c["value"]), F.lit(0.0), lambda a, o: a + F.element_at(w, o["src"] + 1)).alias("support"),
            F.element_at(w, c["src"] + 1).alias("weight"), c["src"].alias("src"), c["value"].alias("value"), c["id"].alias("id"),
        ),
    )
    return F.array_max(scored)


def truth_discovery(
    df: DataFrame, keys: Sequence[str], source: str, order: Sequence[str], fields: Sequence[Field], trust: DataFrame, trust_source: str, trust_level: str, strict: bool = True, least_rows: int = 1, tolerance: float = 1e-6, max_rounds: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(survivors, reliability).

    survivors: keys, n_rows and per field name, name_from (the last order column of the winning claim's row) and
    name_support (share of the weight that stood for it). reliability: field, source, claims, won, reliability, weight.

    strict: trust is a strict order. Sources of one trust level vote as one, and weights of successive levels grow by a
    factor of four, which no coalition of lower levels can outvote whatever their reliability (between one half and
    one) comes out as. Otherwise sources start equal and weights are the log-odds of their reliability alone.

    Rows with a null key are left out. A source that is null or not listed in trust ranks below all and all such vote
    as one. An entity none of whose rows has a usable value gets null. Repeated rows don't change a claim. Ties in
    support go to the more trusted claimant. Reliability that doesn't come to stand in max_rounds fails. Empty inputs give empty results. Columns of df that aren't named are not read.
    """
    listed = _sources(trust, trust_source, trust_level, strict)
    rank = {0: 0} | {k: r for _, k, r in listed}
    n = max(rank) + 1
    normal = F.lower(F.trim(F.col(source)))
    src = F.lit(0)
    for s, k, _ in listed:
        src = F.when(normal == s, k).otherwise(src)
    valid = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    held = materialise(claims(valid, keys, F.coalesce(src, F.lit(0)), order, fields, n, least_rows), "claims")

    reliability = {f.name: [0.8] * n for f in fields}
    counts = {f.name: [(0, 0)] * n for f in fields}

    def weights(f: str) -> list[float]:
        r = reliability[f]
        return [(0.5 + r[s] / 2) * 4.0 ** rank[s] if strict else math.log(r[s] / (1 - r[s])) for s in range(n)]

    def voted() -> DataFrame:
        return held.select("*", *(_vote(F.col(f.name), weights(f.name)).alias(f"__{f.name}") for f in fields))

    def outcomes(f: str) -> Column:
        """Per claim: field, source, whether its value won, and whether another source claims the field too."""
        won, shared = F.col(f"__{f}.value"), F.size(f) > 1
        return F.transform(f, lambda c: F.struct(F.lit(f).alias("f"), c["src"].alias("s"), (c["value"] == won).cast("int").alias("won"), shared.alias("shared")))

    def total(f: str) -> Column:
        w = F.array(*(F.lit(x) for x in weights(f)))
        return F.aggregate(f, F.lit(0.0), lambda a, c: a + F.element_at(w, c["src"] + 1))

    for k in range(max_rounds + 1):
        if k == max_rounds:
            raise ArithmeticError(f"reliability still moves by {moved} after {max_rounds} rounds")
        # only shared claims tell about a source; the sums have one row per field and source
        each = F.explode(F.flatten(F.array(*(outcomes(f.name) for f in fields)))).alias("c")
        rows = voted().select(each).filter("c.shared").groupBy("c.f", "c.s").agg(F.count(F.lit(1)).alias("n"), F.sum("c.won").alias("won")).collect()
        moved = 0.0
        for r in rows:
            # between the bounds, so that no source becomes certain or negative
            new = min(0.99, max(0.51, (r.won + 1) / (r.n + 2)))
            moved = max(moved, abs(new - reliability[r.f][r.s]))
            reliability[r.f][r.s], counts[r.f][r.s] = new, (r.n, r.won)
        if moved <= tolerance:
            break
    out = [*keys, "n_rows"]
    for f in fields:
        w = F.col(f"__{f.name}")
        out += [w["value"].alias(f.name), w["id"].alias(f"{f.name}_from"), (w["support"] / total(f.name)).alias(f"{f.name}_support")]
    names = {0: "(unlisted)"}
    for s, k, _ in listed:
        names[k] = f"{names[k]}, {s}" if k in names and k else s
    report = [(f.name, names.get(s, ""), *counts[f.name][s], reliability[f.name][s], weights(f.name)[s]) for f in fields for s in range(n)]
    spark = df.sparkSession
    return voted().select(*out), spark.createDataFrame(report, "field string, source string, claims long, won long, reliability double, weight double")


def interaction_survivors(interactions: DataFrame, feeds: DataFrame, strict: bool = True, least_rows: int = 2) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over the rows of one user and item; see truth_discovery.

    A rating is usable from 1 to 5, a timestamp from 2000 up to its own row's ingested_at. Users and items that are
    null or negative have no record.
    """
    at = F.unix_micros("ingested_at")
    fields = [
        Field("rating", F.col("ratings"), F.col("ratings").between(1, 5)),
        Field("timestamp", F.col("timestamps"), (F.col("timestamps") >= 946_684_800_000) & (F.col("timestamps") * 1000 <= at)),
    ]
    rows = interactions.filter("user_indices >= 0 and item_indices >= 0")
    return truth_discovery(rows, ["user_indices", "item_indices"], "feed", ["ingested_at", "interaction_id"], fields, feeds, "feed", "trust", strict, least_rows)

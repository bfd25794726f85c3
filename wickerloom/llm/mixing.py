"""Mixing sources to target shares of tokens by entropy balancing.

Documents get the rates closest in relative entropy to one use of each that meet every source's token target within its
cap: min(cap, exp(b_s * size)), tilted to long documents where a source must give more than it has and to short ones
where less. The convex dual has one parameter a source; safeguarded Newton iterations solve it, each one distributed sum
over the documents' sizes. Rates are then rounded into whole copies that meet the targets again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.session import materialise

#: The most sources with targets; one parameter each is held by the driver.
MAX_SOURCES = 1000


def _per_source(name: str, values: dict[str, float]) -> Column:
    """The value of the row's source, 0 for others."""
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0)) if pairs else F.lit(0.0)


def _coarse(bins: list[tuple[float, float]], wanted: float, cap: float, high: float) -> float:
    """b that meets the tokens wanted with all documents of a bin (tokens, mean size) at its mean, by halving."""
    given = lambda b: sum(t * min(cap, math.exp(min(700.0, b * x))) for t, x in bins)
    low = high - 1.0
    while given(low) > wanted:
        low = high - 2 * (high - low)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle) < wanted else (low, middle)
    return (low + high) / 2


def _solve(hist: DataFrame, goal: dict[str, tuple[float, float, float]], tolerance: float) -> dict[str, float]:
    """b per source with sum(size * min(cap, exp(b * size))) = tokens wanted, sizes in units of the source's mean.

    goal: source -> (tokens wanted, mean size, cap). The sum grows with b, so a bracket around the solution keeps every
    step; what isn't met within the tolerance after as many halvings as a double has digits fails.
    """
    # sizes in bins of a 64th of a factor e, some 2,000 a source at most: the driver's solution for them is where the iterations begin
    bins = hist.groupBy("source", F.floor(64 * F.log("n_tokens")).alias("bin")).agg(F.min("n_tokens").alias("low"), F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).collect()
    at, low, high = {}, {}, {}
    for s, (tokens, mean, cap) in goal.items():
        mine = [r for r in bins if r.source == s]
        low[s], high[s] = -math.inf, max(0.0, math.log(cap)) * mean / min(r.low for r in mine)
        at[s] = _coarse([(r.tokens, r.tokens / r.docs / mean) for r in mine], tokens, cap, high[s])
    todo = dict(goal)
    for _ in range(200):
        if not todo:
            return at
        b, m, cap = (_per_source("source", x) for x in ({s: at[s] for s in todo}, {s: g[1] for s, g in todo.items()}, {s: g[2] for s, g in todo.items()}))
        x = F.col("n_tokens") / m
        rate = F.exp(F.least(F.lit(700.0), b * x))
        mine = hist.filter(F.col("source").isin(list(todo))).select("source", (F.col("docs") * F.col("n_tokens")).alias("t"), x.alias("x"), rate.alias("r"), cap.alias("cap"))
        sums = mine.groupBy("source").agg(F.sum(F.col("t") * F.least("r", "cap")).alias("g"), F.sum(F.when(F.col("r") < F.col("cap"), F.col("t") * F.col("x") * F.col("r")).otherwise(0.0)).alias("d")).collect()
        for r in sums:
            s, wanted = r.source, todo[r.source][0]
            if abs(r.g - wanted) <= tolerance * wanted:
                del todo[s]
                continue
            if r.g < wanted:
                low[s] = at[s]
            else:
                high[s] = at[s]
            # Newton on the logarithm of the sum, which is close to linear
            step = at[s] - math.log(r.g / wanted) * r.g / r.d if r.d > 0 and r.g > 0 else math.inf
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if low[s] > -math.inf else high[s] - 2 * max(1.0, abs(high[s]))
            if step in (low[s], high[s]):  # no number between them is closer
                del todo[s]
            at[s] = step
    raise ArithmeticError(f"token targets not met: {sorted(todo)}")


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, source: str = "source", item: str = "doc_id", size: str = "n_tokens", tolerance: float = 1e-7, refinements: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    copies: item, source, size, copies of every document that is used, each at most max_repeats times. shares: per
    source with a target its target_share, max_repeats, documents, tokens, tilt (b of the rates exp(b * size / mean size),
    null where every document is at its cap or the source is absent), copies, mixed_tokens and actual_share.

    Sources match targets without regard to case and outer blanks; others have no target and aren't used, nor are null
    sources and documents of size 0 or null. Without total_tokens the mix is as large as the caps allow with every share
    met: of the present sources, one then has all documents at its cap. With a larger total, sources whose cap is too
    low give all they may and shares miss by what is reported. A target whose source has no tokens gets share 0 and the
    others keep their proportions. Ties between documents are broken by a hash of the item. Duplicate targets of a
    source add up, with the larger cap. No documents or no targets: no copies.
    """
    norm = F.lower(F.trim(F.col(source)))
    t = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(t) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    spark = documents.sparkSession
    wanted = {r.source: (float(r.share), int(r.cap)) for r in t}
    rows = documents.select(F.col(item), norm.alias("source"), F.col(size).cast("long").alias("n_tokens")).filter(F.col("n_tokens") > 0)
    rows = rows.filter(F.col("source").isin(list(wanted))) if wanted else rows.filter("false")
    rows = materialise(rows, "sized")
    # one row per source and size, for the Newton sums; sizes are few whatever the number of documents
    hist = materialise(rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    have = {r.source: (r.docs, r.tokens) for r in hist.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).collect()}
    present = sum(wanted[s][0] for s in have)
    share = {s: wanted[s][0] / present for s in have}
    feasible = min((wanted[s][1] * have[s][1] / share[s] for s in have), default=0.0)
    total = feasible if total_tokens is None else float(total_tokens)
    goal, whole = {}, {}
    for s, (docs, tokens) in have.items():
        want = min(float(wanted[s][1] * tokens), share[s] * total)
        if want >= wanted[s][1] * tokens * (1 - 1e-12):
            whole[s] = (float(wanted[s][1] * tokens), tokens / docs, float(wanted[s][1]))  # every document at its cap
        elif want > 0:
            goal[s] = (want, tokens / docs, float(wanted[s][1]))
    tilt = _solve(hist, goal, tolerance)
    goal |= whole

    b = _per_source("source", {s: p / goal[s][1] for s, p in tilt.items()})
    cap = _per_source("source", {s: g[2] for s, g in goal.items()})
    exponent = F.when(F.col("source").isin(list(whole)), F.lit(math.inf)).otherwise(b * F.col("n_tokens"))
    # rounding: floor, and one more where the document's hash, spread evenly, is below the fraction moved by its source's shift
    rate = F.least(cap, F.round(F.exp(exponent), 9))
    even = (F.pmod(F.xxhash64(item), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    # largest shift at which the document still gets its extra copy; without a fraction or at the cap there's none to get
    rated = rows.withColumn("__floor", F.floor(rate).cast("int")).withColumn("__need", F.when(rate < cap, even - (rate - F.floor(rate))))
    low, high = {s: -1.0 for s in goal}, {s: 1.0 for s in goal}
    bins, reached = 1024, dict.fromkeys(goal, 0)
    for _ in range(refinements if goal else 0):
        crowd = 0
        lo, wide = _per_source("source", low), _per_source("source", {s: high[s] - low[s] for s in goal})
        k = F.floor((F.col("__need") - lo) / wide * bins)
        k = F.when(k < 0, -1).when(k >= bins, bins).otherwise(k)
        got = rated.groupBy("source", k.alias("k")).agg(F.sum(F.col("n_tokens") * F.col("__floor")).alias("base"), F.sum("n_tokens").alias("extra"), F.count(F.lit(1)).alias("n")).collect()
        for s in goal:
            own = sorted((r.k, r.extra, r.n) for r in got if r.source == s and r.k is not None)
            sum_ = sum(r.base for r in got if r.source == s)
            left, step = low[s], (high[s] - low[s]) / bins
            for j, extra, n in own:
                if sum_ + extra > goal[s][0] or j >= bins:
                    low[s], high[s] = (left + j * step, left + (j + 1) * step) if 0 <= j < bins else (left, high[s]) if j < 0 else (high[s], high[s])
                    crowd = max(crowd, n if 0 <= j < bins else 0)
                    break
                sum_ += extra
            else:
                low[s] = high[s]
            reached[s] = sum_
            if high[s] - low[s] < 1e-15:
                high[s] = low[s] + 1e-15
        if crowd < 2:  # every threshold parts single documents
            break
    limit = _per_source("source", low)
    given = rated.withColumn("copies", F.col("__floor") + F.when(F.col("__need") < limit, 1).otherwise(0))
    # what the threshold leaves open is less than one document; of those that fit the largest closes most of it, until none fits
    extra, open_ = [], {s: goal[s][0] - n for s, n in reached.items() if goal[s][0] - n >= 1}
    while open_:
        fits = given.filter((F.col("__need") >= limit) & (F.col("n_tokens") <= _per_source("source", {s: float(g) for s, g in open_.items()})) & ~F.col(item).isin([i for i, _ in extra]))
        found = fits.groupBy("source").agg(F.max_by(F.struct(F.col(item).alias("i"), F.col("n_tokens").alias("n")), F.struct("n_tokens", -F.col("__need"), F.col(item))).alias("d")).collect()
        extra += [(r.d.i, 1) for r in found]
        open_ = {r.source: open_[r.source] - r.d.n for r in found if open_[r.source] - r.d.n >= 1}
    more = spark.createDataFrame(extra, T.StructType([T.StructField("__id", rows.schema[item].dataType), T.StructField("__one", T.IntegerType())]))
    given = given.join(F.broadcast(more), F.col(item) == F.col("__id"), "left").withColumn("copies", F.col("copies") + F.coalesce("__one", F.lit(0)))
    copies = given.filter("copies > 0").select(item, "source", "n_tokens", F.col("copies").cast("int").alias("copies"))
    copies = materialise(copies, "copies")
    used = copies.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    head = spark.createDataFrame([(s, x, c, *have.get(s, (0, 0)), tilt.get(s)) for s, (x, c) in wanted.items()], "source string, target_share double, max_repeats int, documents long, tokens long, tilt double")
    shares = head.join(F.broadcast(used), "source", "left").fillna(0, ["copies", "mixed_tokens"])
    everything = copies.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] or 0
    return copies, shares.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(everything or 1)))

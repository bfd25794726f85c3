"""Listings of one product by multi-pass sorted neighbourhood, soft token alignment and correlation clustering.

A title is brought to a normalised token order: its model (the number that is no measure, with the rarest word before
one), or, where no number names a model, its words, rarest first by document frequency. Equal orders are one node. Nodes
are sorted under several keys (the order with each letter of a word left out, the maker's code, initials), and every
node is compared with all nodes of the same key, so that no pair that aligns is missed however large the catalogue is.
Tokens align softly, weighted by inverse document frequency; numbers align only when equal. Within what is linked,
listings repel one another where a stated value differs and attract one another where values agree, and are clustered
so that no cluster holds a repulsion. Identical statements are one representative throughout, whatever the number of copies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerloom.llm.listings import VARIANTS, one_edit, plain, read_listing, same_value
from wickerloom.session import materialise, spread

#: How much of two names' letters agree, where they share a maker's code; different makers' codes coincide now and then.
SAME_CODE_RATIO = 0.75
#: Letters of the longer of two words that one edit may tell apart.
LEAST_LETTERS = 6
#: Share of two orders' weight together that must align.
ALIGNED = 0.8
#: Share of a word's places right after a model's number from which it is part of the model's name.
VARIANT_SHARE = 0.8

_READ = "item_index int, anchors array<struct<name: string, number: string>>, words array<string>, brand string, longer string, code string, alias string, variants array<string>, category string, stated string"
_PAIR = pa.list_(pa.struct([("name", pa.string()), ("number", pa.string())]))
_ARROW = pa.schema([("item_index", pa.int32()), ("anchors", _PAIR), ("words", pa.list_(pa.string())), *((n, pa.string()) for n in ("brand", "longer", "code", "alias")), ("variants", pa.list_(pa.string())), ("category", pa.string()), ("stated", pa.string())])


def _statements(catalogue: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, title, features, description, categories in zip(*(c.to_pylist() for c in b.columns)):
                x = read_listing(title, features, description)
                # the first member is too wide to tell products apart
                path = [plain(c) for c in categories or [] if c and c.strip()]
                category = path[-1] if len(path) > 1 else ""
                anchors = [{"name": n, "number": k} for n, k in x.anchors]
                rows.append((item, anchors, x.words, x.brand, x.longer, x.code, x.alias, x.variants, category, json.dumps(x.properties, sort_keys=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)

    rows = catalogue.filter("item_index is not null").select(F.col("item_index").cast("int").alias("item_index"), "title", "features", "description", "categories")
    return spread(rows).mapInArrow(read, _READ)


def _with_brands(read: DataFrame, least: int = 2) -> DataFrame:
    """brand: of the names that several listings state as theirs, the most frequent that the listing states or its title holds, as one word or two joined."""
    # a table whose size Spark knows, so that it is broadcast where it is small
    names = materialise(read.filter("brand <> ''").groupBy(F.col("brand").alias("form")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "brands")
    joined = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.concat(F.element_at("words", k), F.element_at("words", k + 1)))
    forms = F.array_distinct(F.concat(F.array("brand", "longer"), "words", F.when(F.size("words") > 1, joined).otherwise(F.array().cast("array<string>"))))
    each = read.select("item_index", F.posexplode(forms).alias("place", "form")).filter("form <> ''")
    found = each.join(names, "form").groupBy("item_index").agg(F.max_by("form", F.struct("n", -F.col("place"))).alias("brand"))
    return read.drop("brand", "longer").join(found, "item_index", "left").fillna("", ["brand"])


def _frequencies(read: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, n): titles of the whole catalogue by word, of the asked words (word)."""
    asked = materialise(asked.select("word").distinct(), "asked")
    return read.select(F.explode(F.array_distinct("words")).alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _variants(read: DataFrame) -> list[str]:
    """Words of VARIANTS that stand mostly after a model's number; elsewhere they are marketing."""
    after = read.select(F.explode("variants").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("after"))
    everywhere = read.select(F.explode("words").alias("word")).filter(F.col("word").isin(sorted(VARIANTS))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # one row per entry of VARIANTS at most
    return [r.word for r in after.join(everywhere, "word").filter(F.col("after") >= VARIANT_SHARE * F.col("n")).select("word").collect()]


def _ordered(read: DataFrame) -> DataFrame:
    """read with order and number: the model whose name is the rarest word, or all words in alphabetical order and no number."""
    several = read.filter("size(anchors) > 1").select("item_index", F.explode("anchors").alias("a"))
    rarest = several.join(_frequencies(read, several.select(F.col("a.name").alias("word"))), F.col("a.name") == F.col("word")).groupBy("item_index").agg(F.min_by("a", F.struct("n", "a.name", "a.number")).alias("rarest"))
    with_one = read.join(rarest, "item_index", "left").withColumn("a", F.coalesce("rarest", F.try_element_at("anchors", F.lit(1))))
    words = F.array_join(F.array_sort(F.array_distinct("words")), " ")
    named = F.when(F.col("a").isNotNull(), F.col("a.name")).when(words != "", words).otherwise(F.concat(F.lit("#"), "item_index"))
    return with_one.withColumn("order", named).withColumn("number", F.coalesce("a.number", F.lit(""))).drop("anchors", "rarest", "a")


def _left_out(word: str) -> str:
    """SQL of the keys of a word: with its number, the whole word and the word without each one of its letters.

    A long word's keys are its two ends instead, of which one edit leaves one as it is; about 60 letters have both kinds.
    """
    each = f"transform(sequence(0, length({word})), k -> xxhash64(number, concat(left({word}, k - 1), substring({word}, k + 1))))"
    ends = f"array(xxhash64(number, 'first', left({word}, 28)), xxhash64(number, 'last', right({word}, 28)))"
    return f"concat(if(length({word}) <= 64, {each}, array()), if(length({word}) >= 58, {ends}, array()))"


def _keys(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """(node, key, coded, probe): any two nodes that can align share a key, under which one of them probes.

    Words one edit apart are equal once the right letter is left out of each, or of the longer one.
    """
    spelt = F.expr(f"if(number <> '' and length(order) >= {LEAST_LETTERS - 1}, {_left_out('order')}, array())")
    short = F.expr("if(number <> '' and length(order) < 5, array(xxhash64('initials', concat(order, ' ', number))), array())")
    alias = F.expr("if(alias <> '', array(xxhash64('initials', alias)), array())")
    keys = nodes.select("node", F.explode(F.array_distinct(F.concat(spelt, short, alias))).alias("key"), F.lit(False).alias("coded"), F.lit(True).alias("probe"))
    codes = said.filter("code <> '' and number <> ''").select("order", "number", "code").distinct().join(nodes.select("order", "number", "node"), ["order", "number"])
    keys = keys.unionByName(codes.select("node", F.xxhash64(F.lit("code"), "code").alias("key"), F.lit(True).alias("coded"), F.lit(True).alias("probe")))
    each = nodes.filter("number = '' and size(tokens) >= 3").select("node", "number", F.posexplode("tokens").alias("place", "word"), F.size("tokens").alias("size"))
    # tokens stand rarest first; at most a third of a side's weight stays without a counterpart, so one of its rarest has one
    each = each.select("node", F.expr("place <= size div 3").alias("probe"), F.explode(F.expr(_left_out("word"))).alias("key"))
    return keys.unionByName(each.groupBy("node", "key").agg(F.lit(False).alias("coded"), F.max("probe").alias("probe")))


_SIDE = ("order", "number", "brand", "category", "alias", "tokens", "weights")


def _run_links(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """(a, b) of nodes that are one series: sorted by key, each window is the whole run of a key, whatever its length."""
    keyed = _keys(nodes, said).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    runs = keyed.join(nodes.select("node", *_SIDE), "node").repartition("key").select("key", "coded", "probe", "node", *_SIDE).sortWithinPartitions("key", F.desc("probe"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            left, right = [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    held = []
                for other in held:
                    if other[3] != row[3] and _aligned(other[4:], row[4:], row[1]):
                        left.append(other[3])
                        right.append(row[3])
                if row[2]:
                    held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return runs.mapInArrow(compare, "a long, b long")


def _alike(a: str, b: str) -> bool:
    """Whether the letters agree by SAME_CODE_RATIO, in either order of the two; the quick ratios are upper bounds."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= SAME_CODE_RATIO and m.quick_ratio() >= SAME_CODE_RATIO and (m.ratio() >= SAME_CODE_RATIO or SequenceMatcher(None, b, a).ratio() >= SAME_CODE_RATIO)


def aligned_share(u: list[str], wu: list[float], v: list[str], wv: list[float]) -> float:
    """Share of both sides' weight that aligns; a token aligns with an equal one or, from LEAST_LETTERS on, with one an edit away."""
    left = dict(zip(v, wv))
    shared, rest = 0.0, []
    for t, w in zip(u, wu):
        if t in left:
            shared += min(w, left.pop(t))
        else:
            rest.append((t, w))
    for t, w in rest:
        for o in left:
            if max(len(t), len(o)) >= LEAST_LETTERS and abs(len(t) - len(o)) <= 1 and one_edit(t, o):
                # a misspelling is rarer than its word; what both weigh is the word's weight
                shared += max(w, left.pop(o))
                break
    return 2 * shared / max(sum(wu) + sum(wv), 1e-9)


def _aligned(x: tuple, y: tuple, coded: bool) -> bool:
    """Soft alignment of two nodes, which share a maker's code if coded; what is empty doesn't separate."""
    (order, number, brand, category, alias, tokens, weights), (order2, number2, brand2, category2, alias2, tokens2, weights2) = x, y
    if (category and category2 and category != category2) or (brand and brand2 and not one_edit(brand, brand2)):
        return False
    if f"{order} {number}" == alias2 or f"{order2} {number2}" == alias:
        return True
    if number != number2:
        return False
    if coded and _alike(order, order2):
        return True
    if number:
        return max(len(order), len(order2)) >= LEAST_LETTERS and one_edit(order, order2)
    return min(len(tokens), len(tokens2)) >= 3 and aligned_share(tokens, weights, tokens2, weights2) >= ALIGNED


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by label spreading with pointer jumps until nothing changes."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    linked = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    done = False
    while not done:
        spread = both.join(linked, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("r"))
        new = linked.join(spread, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("r", "root")).alias("new"), "root")
        up = new.select(F.col("node").alias("p"), F.col("new").alias("p_root"))
        jumped = materialise(new.join(up, F.col("new") == F.col("p"), "left").select("node", F.least("new", F.coalesce("p_root", "new")).alias("next"), "root"), "roots")
        done = jumped.filter("next <> root").isEmpty()
        linked = jumped.select("node", F.col("next").alias("root"))
    return nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def correlate(statements: Iterator[tuple[str, str, dict]]) -> Iterator[int]:
    """Cluster number of each (code, brand, properties) of one series, as they come: those with a code and those that say most first.

    A statement joins the cluster it agrees with in most values among those whose every member it doesn't contradict;
    a common maker's code outweighs everything, and of equals the one with most members wins. No generation means the
    first, no variant the plain model. Only the clusters are held.
    """
    clusters: list[dict] = []
    for code, brand, stated in statements:
        properties = {"generation": 1.0, "variant": ""} | stated
        best, place = None, None
        for n, c in enumerate(clusters):
            same_code = bool(code) and code in c["codes"]
            if not same_code and ((code and c["codes"]) or (brand and c["brand"] and not one_edit(brand, c["brand"]))):
                continue
            shared = [k for k in properties if k in c["properties"]]
            if not same_code and not all(same_value(properties[k], c["properties"][k]) for k in shared):
                continue
            score = (same_code, len(shared), c["n"], -n)
            if best is None or score > best:
                best, place = score, n
        if place is None:
            clusters.append({"codes": set(), "brand": "", "properties": {}, "n": 0})
            place = len(clusters) - 1
        c = clusters[place]
        c["codes"] |= {code} - {""}
        c["brand"] = c["brand"] or brand
        c["properties"] = properties | c["properties"]
        c["n"] += 1
        yield place


def _nodes(said: DataFrame) -> DataFrame:
    """One row per order and number, with its tokens, rarest first, and their weights."""
    names = said.groupBy("order", "number").agg(
        F.min("item_index").cast("long").alias("node"), F.max("brand").alias("brand"), F.max("category").alias("category"), F.max("alias").alias("alias")
    )
    plain_ = names.filter("number = ''").select("node", F.explode(F.split("order", " ")).alias("word"))
    total = F.lit(float(said.count() or 1))
    weighed = plain_.join(_frequencies(said, plain_), "word").select("node", F.struct(F.col("n"), F.col("word"), F.log1p(total / F.col("n")).alias("w")).alias("t"))
    # a title's words
    rare = weighed.groupBy("node").agg(F.array_sort(F.collect_list("t")).alias("t")).select("node", F.transform("t", lambda t: t["word"]).alias("tokens"), F.transform("t", lambda t: t["w"]).alias("weights"))
    return names.join(rare, "node", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("weights", F.coalesce("weights", F.array().cast("array<double>")))


def product_groups(catalogue: DataFrame) -> DataFrame:
    """(item_index, group): one row per listing, with the same group for listings of the same product.

    Same product: same brand and model, softly aligned, same generation and variant and no property (colour, pack, power,
    storage, charge, volume, weight, length, sensor, refresh rate, resolution, ports) stated with different values, in
    whatever wording or unit; a common maker's code is decisive. What a listing leaves out doesn't separate it. group
    is the smallest item_index of the product. A listing of which nothing can be read is a group of its own. Null
    items are left out; null or empty columns state nothing; whole texts are read. An empty catalogue gives no rows.
    """
    read = materialise(_statements(catalogue), "statements")
    said = materialise(_with_brands(_ordered(read)), "branded")
    nodes = materialise(_nodes(said), "nodes")
    roots = components(nodes, materialise(_run_links(nodes, said).distinct(), "aligned"))
    series = nodes.select("node", "order", "number").join(roots, "node").select("order", "number", F.col("root").alias("series_root"))
    variants = F.array(*map(F.lit, _variants(read))).cast("array<string>")
    variant = F.coalesce(F.try_element_at(F.filter("variants", lambda v: F.array_contains(variants, v)), F.lit(1)), F.lit(""))
    placed = materialise(said.join(series, ["order", "number"]).select("item_index", "series_root", "code", "brand", "stated", variant.alias("variant")), "placed")
    # identical statements are one representative
    statement = ["series_root", "code", "brand", "stated", "variant"]
    reps = placed.groupBy(*statement).agg(F.min("item_index").alias("rep"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, feed, out = None, [], None
        for b in batches:
            numbers = []
            for series_root, code, brand, stated, var in zip(*(c.to_pylist() for c in b.columns[:5])):
                if out is None or series_root != root:
                    root, feed = series_root, []
                    out = correlate(iter(feed.pop, None))
                feed.append((code, brand, json.loads(stated) | ({"variant": var} if var else {})))
                numbers.append(next(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(numbers, pa.int32()), b.column(5)], names=[*statement, "cluster", "rep"])

    said_much = [F.col("code") == "", F.desc(F.size(F.split("stated", ": "))), "rep"]
    together = reps.select(*statement, "rep").repartition("series_root").sortWithinPartitions("series_root", *said_much)
    clusters = together.mapInArrow(cluster, "series_root long, code string, brand string, stated string, variant string, cluster int, rep int")
    # a cluster has a row per distinct statement
    least = F.min("rep").over(Window.partitionBy("series_root", "cluster")).alias("group")
    grouped = clusters.select(*statement, least)
    return placed.join(grouped, statement).select("item_index", "group")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(item_a, item_b), smaller first, of all listings of one group."""
    kept = materialise(groups, "groups")
    return kept.select(F.col("item_index").alias("item_a"), "group").join(kept.select(F.col("item_index").alias("item_b"), "group"), "group").filter("item_a < item_b").select("item_a", "item_b")

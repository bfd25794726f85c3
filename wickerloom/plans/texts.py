"""Queries of §2.2 and 2.8 on catalogue and document texts, and of §2.11 on their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerloom.functions import tokens
from wickerloom.operators import catalogue as C
from wickerloom.operators import text as X
from wickerloom.plans.registry import Registry
from wickerloom.sources.tables import table

TEXTS = Registry()
query = TEXTS.query
#: White space of texts as DuckDB's patterns name it.
SP = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def sql_clean(c: str) -> str:
    return sql_collapse(f"regexp_replace({c}, '(?i)\\s*see more\\s*', ' ', 'g')")


def _list(c: str) -> str:
    return f"list_filter(list_transform({c}, lambda x: {sql_clean('x')}), lambda x: x <> '')"


@query("str_01_clean_titles", f"SELECT item_index, {sql_clean('title')} AS title FROM product_catalog")
def clean_titles(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").select("item_index", X.clean_text(F.col("title")).alias("title"))


@query("str_02_clean_features", f"SELECT item_index, coalesce(array_to_string({_list('features')}, '|'), '') AS features, coalesce(len({_list('features')}), 0) AS n FROM product_catalog")
def clean_features(spark, sf_dir):
    f = X.clean_list(F.col("features"))
    return table(spark, sf_dir, "product_catalog").select("item_index", F.array_join(f, "|").alias("features"), F.size(f).cast("long").alias("n"))


_PRODUCT_TEXT = f"""SELECT item_index, concat_ws(chr(10),
  CASE WHEN {sql_clean('title')} <> '' THEN 'Title: ' || {sql_clean('title')} END,
  CASE WHEN len({_list('categories')}) > 0 THEN 'Category: ' || array_to_string({_list('categories')}, ' > ') END,
  CASE WHEN len({_list('features')}) > 0 THEN 'Features: ' || array_to_string({_list('features')}, ' | ') END,
  CASE WHEN {sql_clean('description')} <> '' THEN 'Description: ' || {sql_clean('description')} END) AS text FROM product_catalog"""


@query("str_04_product_text", _PRODUCT_TEXT)
def product_text(spark, sf_dir):
    return X.product_text(table(spark, sf_dir, "product_catalog"))


@query("str_07_section", f"SELECT item_index, regexp_extract(text, '(?m)^Category: (.*)$', 1) AS category FROM ({_PRODUCT_TEXT})")
def category_section(spark, sf_dir):
    return X.product_text(table(spark, sf_dir, "product_catalog")).select("item_index", X.section(F.col("text"), "Category").alias("category"))


@query("str_10_category_sizes", f"""
SELECT category, count(*) AS n FROM (SELECT DISTINCT item_index, lower({sql_collapse('c')}) AS category FROM (SELECT item_index, unnest(categories) AS c FROM product_catalog)) WHERE category <> ''
GROUP BY category HAVING count(*) >= 10 ORDER BY n DESC, category LIMIT 20""")  # fmt: skip
def category_sizes(spark, sf_dir):
    return C.categories_by_size(table(spark, sf_dir, "product_catalog"), "categories", 10, 20)


_INDEX = f"""WITH t AS (SELECT DISTINCT item_index, unnest(regexp_extract_all(lower(f), '{X.TOKEN}')) AS token FROM (SELECT item_index, unnest(features) AS f FROM product_catalog) WHERE f IS NOT NULL)"""


@query("agg_23_inverted_index", _INDEX + "SELECT token, item_index FROM t")
def inverted_index(spark, sf_dir):
    return C.inverted_index(table(spark, sf_dir, "product_catalog"), "item_index", "features")


@query("join_07_all_tokens", _INDEX + "SELECT item_index FROM t WHERE token IN ('usb-c', 'power', 'delivery') GROUP BY item_index HAVING count(*) = 3")
def all_tokens(spark, sf_dir):
    return C.having_all_tokens(C.inverted_index(table(spark, sf_dir, "product_catalog"), "item_index", "features"), "item_index", ["usb-c", "power", "delivery"])


@query("flt_05_category_members", f"""
SELECT item_index FROM product_catalog WHERE list_contains(list_transform(categories, lambda c: lower({sql_collapse('c')})), 'docking stations')""")  # fmt: skip
def category_members(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").filter(C.in_category(F.col("categories"), " Docking   Stations ")).select("item_index")


_PHRASE = f"""list_bool_or(list_transform(list_filter(features, lambda f: f IS NOT NULL),
  lambda f: ' ' || array_to_string(regexp_extract_all(lower(f), '{X.TOKEN}'), ' ') || ' ' LIKE '% {{}} %'))"""


@query("flt_07_required_features", f"SELECT item_index FROM product_catalog WHERE coalesce({_PHRASE.format('usb-c')}, false) AND coalesce({_PHRASE.format('hdmi video output')}, false)")
def required_features(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").filter(C.has_features(F.col("features"), ["USB-C", "HDMI video output"])).select("item_index")


@query("flt_09_combined_filter", f"""
SELECT item_index FROM product_catalog WHERE list_contains(list_transform(categories, lambda c: lower({sql_collapse('c')})), 'docking stations')
AND coalesce({_PHRASE.format('gigabit ethernet')}, false) AND average_rating >= 4 AND item_index NOT IN (SELECT item_indices FROM train WHERE user_indices < 0)""")  # fmt: skip
def combined_filter(spark, sf_dir):
    excluded = table(spark, sf_dir, "train").filter("user_indices < 0").select(F.col("item_indices").alias("item_index"))
    kept = table(spark, sf_dir, "product_catalog").filter(C.in_category(F.col("categories"), "Docking Stations") & C.has_features(F.col("features"), ["Gigabit Ethernet"]) & C.within("average_rating", 4))
    return kept.join(excluded, "item_index", "left_anti").select("item_index")


@query("str_22_text_sizes", f"""
SELECT doc_id, coalesce(length(text), 0) AS chars, CASE WHEN text IS NULL OR {sql_collapse('text')} = '' THEN 0 ELSE len(string_split({sql_collapse('text')}, ' ')) END AS words FROM documents""")  # fmt: skip
def text_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), X.word_count(F.col("text")).cast("long").alias("words"))


@query("str_16_truncated_titles", r"SELECT item_index, CASE WHEN length(title) <= 40 THEN title ELSE regexp_replace(title[1:37], '\s\S*$', '') || '...' END AS title FROM product_catalog")
def truncated_titles(spark, sf_dir):
    return table(spark, sf_dir, "product_catalog").select("item_index", X.truncate_words(F.col("title"), 40).alias("title"))


@query("str_17_formatted_numbers", "SELECT item_index, coalesce('$' || printf('%.2f', CASE WHEN isfinite(price) AND price > 0 THEN price END), 'no price') AS price, coalesce(printf('%.1f / 5', average_rating), 'no rating') AS rating, coalesce(CAST(rating_number AS VARCHAR), 'no count') AS n FROM product_catalog")
def formatted_numbers(spark, sf_dir):
    p = F.col("price")
    or_ = lambda c, f, no: F.when(c.isNotNull(), f).otherwise(F.lit(no))
    valid = F.when(~F.isnan(p) & (p < float("inf")) & (p > 0), p)
    return table(spark, sf_dir, "product_catalog").select("item_index", or_(valid, F.format_string("$%.2f", p), "no price").alias("price"), or_(F.col("average_rating"), F.format_string("%.1f / 5", "average_rating"), "no rating").alias("rating"), F.coalesce(F.col("rating_number").cast("string"), F.lit("no count")).alias("n"))


def packed_sql(words: str, limit: int) -> str:
    """The parts of a list of words, as pack_words fills them; a part ends at chr(31)."""
    return f"string_split(list_reduce({words}, lambda a, w: CASE WHEN length(string_split(a, chr(31))[-1]) + 1 + length(w) <= {limit} THEN a || ' ' || w ELSE a || chr(31) || w END), chr(31))"


@query("win_12_word_packing", f"""
WITH w AS (SELECT doc_id, list_filter(string_split({sql_collapse('text')}, ' '), lambda x: x <> '') AS ws FROM documents), p AS (SELECT doc_id, {packed_sql('ws', 400)} AS parts FROM w WHERE len(ws) > 0)
SELECT doc_id, generate_subscripts(parts, 1) - 1 AS part, unnest(parts) AS text FROM p""")  # fmt: skip
def word_packing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pack_words(F.col("text"), 400)).alias("part", "text")).withColumn("part", F.col("part").cast("long"))


@query("str_05_within_budget")
def within_budget(spark, sf_dir):
    """Product documents of 2,048 tokens at most; there's no tokenizer in SQL."""
    lines = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    c = table(spark, sf_dir, "product_catalog").select(
        "item_index", lines("Title", X.clean_text(F.col("title"))).alias("a"), lines("Category", F.array_join(X.clean_list(F.col("categories")), " > ")).alias("b"), lines("Features", F.array_join(X.clean_list(F.col("features")), " | ")).alias("c"),
        lines("Description", X.clean_text(F.col("description"))).alias("d"),
    )
    return tokens.within_budget(c, ["item_index"], ["a", "b", "c", "d"], 2048)


@query("win_11_context_budget", """
WITH r AS (SELECT source, doc_id, length(text) AS l, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id) AS rank FROM documents WHERE length(text) > 0),
c AS (SELECT *, sum(l) OVER (PARTITION BY source ORDER BY rank) AS used FROM r)
SELECT source, doc_id, rank, CAST(used AS BIGINT) AS used FROM c WHERE used <= 12000""")  # fmt: skip
def context_budget(spark, sf_dir):
    from pyspark.sql import Window

    # a row at place n has used n characters at least, so places beyond the budget can't fit; Spark cuts them before the shuffle
    order = Window.partitionBy("source").orderBy(F.desc_nulls_last("created_at"), "doc_id")
    ranked = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("source", "doc_id", "created_at", "text").withColumn("rank", F.row_number().over(order)).filter("rank <= 12000")
    return X.context_blocks(ranked, "source", "text", 12_000).select("source", "doc_id", F.col("rank").cast("long").alias("rank"), "used")


#: Required features with their aliases.
FEATURES = {"HDMI": ["hdmi"], "USB-C": ["usb-c", "type-c"]}


def _evidence_sql(aliases: list[str]) -> str:
    alias = X.alias_pattern(aliases).replace("'", "''")
    denied, lower = (X.DENYING + alias + "([^a-z0-9]|$)").replace("doesn['", "doesn[''"), sql_collapse("translate(lower(text), '‐‑‒–—―−', '-------')")
    rest = f"regexp_replace({lower}, '{denied}', chr(1) || '\\1', 'g')"
    affirmed = f"{X.AFFIRMING}{alias}(?:[^a-z0-9]|$)|(?:^|[^a-z0-9]){alias}{X.AFTER}(?:[^a-z0-9_]|$)|^{alias}$"
    return f"coalesce(regexp_matches({rest}, '{affirmed}'), false) AS supports, coalesce(regexp_matches({lower}, '{denied}'), false) AS contradicts"


_EVIDENCE = " UNION ALL ".join(f"SELECT doc_id, item_index, '{name}' AS feature, {_evidence_sql(a)} FROM documents" for name, a in FEATURES.items())


def _evidence(spark, sf_dir):
    """(doc_id, item_index, feature, supports, contradicts) of every text and feature, in one scan."""
    each = [F.struct(F.lit(name).alias("feature"), *(c.alias(n) for n, c in zip(("supports", "contradicts"), X.evidence(F.col("text"), a)))) for name, a in FEATURES.items()]
    return table(spark, sf_dir, "documents").select("doc_id", "item_index", F.explode(F.array(*each)).alias("e")).select("doc_id", "item_index", "e.*")


@query("ver_01_evidence_sentences", f"SELECT doc_id, feature, supports, contradicts FROM ({_EVIDENCE}) WHERE supports OR contradicts")
def evidence_sentences(spark, sf_dir):
    return _evidence(spark, sf_dir).filter("supports or contradicts").select("doc_id", "feature", "supports", "contradicts")


@query("ver_02_item_evidence", f"""
WITH s AS (SELECT item_index, feature, count(*) FILTER (WHERE supports) AS n_support, count(*) FILTER (WHERE contradicts) AS n_contradict FROM ({_EVIDENCE}) WHERE item_index IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CASE WHEN n_support > 0 AND n_contradict = 0 THEN 'supported' WHEN n_support = 0 AND n_contradict > 0 THEN 'contradicted' ELSE 'unknown' END AS state FROM s)
SELECT item_index, sum(n_support) AS n_support, sum(n_contradict) AS n_contradict,
  CASE WHEN count(*) FILTER (WHERE state = 'contradicted') > 0 THEN 'ineligible' WHEN count(*) FILTER (WHERE state = 'supported') = count(*) THEN 'eligible' ELSE 'unverified' END AS status FROM c GROUP BY item_index""")  # fmt: skip
def item_evidence(spark, sf_dir):
    """Each item's status over all required features: one contradicted makes it ineligible, all supported eligible."""
    states = _evidence(spark, sf_dir).filter("item_index is not null").groupBy("item_index", "feature").agg(F.count_if("supports").alias("n_support"), F.count_if("contradicts").alias("n_contradict"))
    support, contradict = F.col("n_support") > 0, F.col("n_contradict") > 0
    return states.groupBy("item_index").agg(
        F.sum("n_support").alias("n_support"), F.sum("n_contradict").alias("n_contradict"),
        F.when(F.count_if(contradict & ~support) > 0, "ineligible").when(F.count_if(support & ~contradict) == F.count(F.lit(1)), "eligible").otherwise("unverified").alias("status"),
    )


@query("dq_02_duplicate_chunk_ids", "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1")
def duplicate_chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("dq_09_chunk_defects", """
SELECT count(*) AS n, count(*) FILTER (WHERE chunk_type IS NULL) AS no_type, count(*) FILTER (WHERE length(text) > 1600) AS too_long, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty,
       count(*) FILTER (WHERE c.parent_asin IS DISTINCT FROM p.parent_asin) AS other_parent
FROM chunks c LEFT JOIN product_catalog p USING (item_index)""")  # fmt: skip
def chunk_defects(spark, sf_dir):
    parents = table(spark, sf_dir, "product_catalog").select("item_index", F.col("parent_asin").alias("p"))
    rows = table(spark, sf_dir, "chunks").join(parents, "item_index", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("chunk_type").isNull()).alias("no_type"), F.count_if(F.length("text") > 1600).alias("too_long"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), F.count_if(~F.col("parent_asin").eqNullSafe(F.col("p"))).alias("other_parent")
    )


@query("dq_03_document_set", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (WHERE n_chars <> coalesce(length(text), 0)) AS wrong_size FROM documents")
def document_set(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), F.count_if(F.col("n_chars") != F.coalesce(F.length("text"), F.lit(0))).alias("wrong_size"))


@query("dq_06_rating_and_time", """
SELECT lower(trim(feed)) AS feed, count(*) AS n, count(*) FILTER (WHERE ratings IS NULL OR isnan(ratings) OR NOT ratings BETWEEN 1 AND 5) AS bad_rating, count(*) FILTER (WHERE timestamps IS NULL OR timestamps < 0) AS bad_time
FROM enriched_interactions GROUP BY 1""")  # fmt: skip
def rating_and_time(spark, sf_dir):
    r = F.col("ratings")
    return table(spark, sf_dir, "enriched_interactions").groupBy(F.lower(F.trim("feed")).alias("feed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r.isNull() | F.isnan(r) | ~r.between(1, 5)).alias("bad_rating"), F.count_if(F.col("timestamps").isNull() | (F.col("timestamps") < 0)).alias("bad_time")
    )

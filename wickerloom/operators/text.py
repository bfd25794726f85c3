"""Product texts: cleaning, sections, tokens, word packing and context blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+(?:[-+./][a-z0-9]+)*"


def collapse(c: Column) -> Column:
    """Trimmed, with every run of white space, also of other scripts, one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """collapse without the words "See more"."""
    return collapse(F.regexp_replace(c, r"(?i)\s*see more\s*", " "))


def clean_list(c: Column) -> Column:
    """clean_text of each entry, without null and empty ones; null becomes an empty list."""
    return F.coalesce(F.filter(F.transform(c, clean_text), lambda x: x != ""), F.array().cast("array<string>"))


def category_form(c: Column) -> Column:
    return F.lower(collapse(c))


def feature_tokens(c: Column) -> Column:
    """Lower-case tokens; marks within a token, as in usb-c, belong to it."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands in the tokens, without a gap."""
    q, n = F.array(*map(F.lit, phrase)), len(phrase)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda s: F.slice(tokens, s, n) == q)


def sections(**parts: Column) -> Column:
    """Labelled lines of the parts that hold something, in the given order."""
    return F.concat_ws("\n", *(F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label.replace('_', ' ').capitalize()}: "), c)) for label, c in parts.items()))


def section(text: Column, label: str) -> Column:
    """The rest of the line that begins with the label."""
    return F.regexp_extract(text, rf"(?m)^{label}: (.*)$", 1)


def product_text(df: DataFrame) -> DataFrame:
    """(item_index, text): title, category path, features and description as labelled lines."""
    text = sections(
        title=clean_text(F.col("title")), category=F.array_join(clean_list(F.col("categories")), " > "), features=F.array_join(clean_list(F.col("features")), " | "), description=clean_text(F.col("description"))
    )
    return df.select("item_index", text.alias("text"))


def word_count(c: Column) -> Column:
    words = collapse(c)
    return F.when(c.isNull(), 0).when(words == "", 0).otherwise(F.size(F.split(words, " ")))


def truncate_words(c: Column, limit: int) -> Column:
    """c within limit characters, cut at a word with ... at the end."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 3), r"\s\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def pack_words(c: Column, limit: int) -> Column:
    """The text's words in parts of at most limit characters, filled greedily; a longer word is a part of its own."""
    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"))

    def add(a: Column, w: Column) -> Column:
        fits = (a["part"] != "") & (F.length(a["part"]) + 1 + F.length(w) <= limit)
        done = F.when(fits | (a["part"] == ""), a["done"]).otherwise(F.array_append(a["done"], a["part"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat_ws(" ", a["part"], w)).otherwise(w).alias("part"))

    return F.aggregate(words, start, add, lambda a: F.when(a["part"] == "", a["done"]).otherwise(F.array_append(a["done"], a["part"])))


def context_blocks(ranked: DataFrame, group: str, text: str, budget: int) -> DataFrame:
    """The rows of each group in rank order whose texts fit into the budget together, the first that doesn't fit ends it."""
    before = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("used", F.sum(F.length(text)).over(before)).filter(F.col("used") <= budget)


#: What stands right before a feature that is denied, and before or after one that is affirmed.
DENYING = r"(?:does\s+not\s+support|doesn['’]t\s+support|not\s+compatible\s+with|without|no|lacks?|lack\s+of)\s+"
AFFIRMING = r"(?:supports?|compatible\s+with|includes?|has|with|equipped\s+with)\s+"
AFTER = r"\s+(?:output|input|ports?|connectors?|interfaces?|hub|support|supported|compatible)"


def alias_pattern(aliases: Sequence[str]) -> str:
    """The aliases as one pattern, literally but for blanks and dashes, which stand for one another."""
    forms = ["[\\s-]+".join(re.escape(p) for p in re.split(r"[\s-]+", a.lower()) if p) for a in aliases]
    return f"(?:{'|'.join(forms)})"


def evidence(text: Column, aliases: Sequence[str]) -> tuple[Column, Column]:
    """(supports, contradicts): whether a text affirms or denies the feature, occurrence by occurrence.

    An occurrence right after a denying phrase contradicts; any other supports if an affirming phrase stands right before
    it, a word such as port right after it, or nothing else in the text. Null texts tell nothing.
    """
    alias = alias_pattern(aliases)
    lower = collapse(F.translate(F.lower(text), "‐‑‒–—―−", "-------"))
    denied = f"{DENYING}{alias}([^a-z0-9]|$)"
    # a mark in the place of what is denied keeps its neighbours apart
    rest = F.regexp_replace(lower, denied, "\u0001$1")
    affirmed = f"{AFFIRMING}{alias}(?:[^a-z0-9]|$)|(?:^|[^a-z0-9]){alias}{AFTER}(?:[^a-z0-9_]|$)|^{alias}$"
    tells = lambda c: F.coalesce(c, F.lit(False))
    return tells(rest.rlike(affirmed)), tells(lower.rlike(denied))


LABELS = ("Title", "Category", "Features", "Description")


def wrapped_section(text: Column, label: str, labels: tuple[str, ...] = LABELS) -> Column:
    """The text after the label up to the next label or the end, lines that wrap included; null if there is none."""
    found = F.regexp_extract(text, rf"(?ms)^{label}:(.*?)(?=^(?:{'|'.join(labels)}):|\z)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"\s*\n\s*", "\n"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def split_entries(text: Column, mark: str) -> Column:
    """Entries between marks, trimmed, without empty ones; null becomes an empty list."""
    parts = F.filter(F.transform(F.split(text, rf"\s*\{mark}\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def parse_product_text(df: DataFrame) -> DataFrame:
    """(item_index, title, categories, features, description) of labelled product texts; the inverse of product_text."""
    category = wrapped_section(F.col("text"), "Category")
    members = F.when(F.contains(category, F.lit("|")), split_entries(category, "|")).otherwise(split_entries(category, ">"))
    return df.select(
        "item_index", wrapped_section(F.col("text"), "Title").alias("title"), members.alias("categories"), split_entries(wrapped_section(F.col("text"), "Features"), "|").alias("features"), wrapped_section(F.col("text"), "Description").alias("description")
    )


def details_text(details: Column, without: tuple[str, ...] = (), longest: int = 500) -> Column:
    """Entries of a map as "key: value" between " | ", cleaned, long values cut; keys in `without` and empty ones left out."""
    entries = F.transform(F.map_entries(details), lambda e: F.struct(e["key"].alias("raw"), clean_text(e["key"]).alias("k"), clean_text(e["value"]).alias("v")))
    kept = F.filter(entries, lambda e: (e["k"] != "") & (e["v"] != "") & ~e["raw"].isin(list(without)))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit(": "), F.when(F.length(e["v"]) > longest, F.concat(F.substring(e["v"], 1, longest), F.lit("..."))).otherwise(e["v"]))), " | ")


def without_prefix(text: Column, prefixes: list[str]) -> Column:
    """text without the longest of the prefixes it begins with; a prefix that ends in a Latin letter must be followed by a space."""
    out = text
    for p in sorted(prefixes, key=len):
        whole = p + " " if p[-1].isascii() and p[-1].isalnum() else p
        out = F.when(F.startswith(text, F.lit(whole)), F.trim(F.substring(text, F.lit(len(whole) + 1), F.length(text)))).otherwise(out)
    return out


def knowledge_chunks(catalogue: DataFrame, limit: int = 1600) -> DataFrame:
    """(chunk_id, item_index, parent_asin, chunk_type, part_index, text): a summary and, where there are any, features and description, packed by words."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    rating = F.concat(F.lit("Average rating: "), number("average_rating"), F.when(F.col("rating_number").isNotNull(), F.concat(F.lit(" ("), F.col("rating_number").cast("string"), F.lit(" ratings)"))).otherwise(F.lit("")))
    members = clean_list(F.col("categories"))
    lines = F.filter(
        F.array(
            F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")), F.when(F.size(members) > 0, F.concat(F.lit("Categories: "), F.array_join(members, " | "))),
            F.when(usable("price"), F.concat(F.lit("Price: "), number("price"))), F.when(usable("average_rating"), rating),
        ),
        lambda x: x.isNotNull(),
    )
    summary = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.concat(F.lit("Parent ASIN: "), "parent_asin"))
    kinds = F.array(
        F.struct(F.lit("summary").alias("chunk_type"), summary.alias("t")), F.struct(F.lit("features").alias("chunk_type"), F.array_join("features", "\n").alias("t")), F.struct(F.lit("description").alias("chunk_type"), F.col("description").alias("t"))
    )
    texts = catalogue.select("item_index", "parent_asin", F.explode(kinds).alias("x")).select("item_index", "parent_asin", "x.chunk_type", "x.t").filter("t is not null")
    parts = texts.select("item_index", "parent_asin", "chunk_type", F.posexplode(pack_words(F.col("t"), limit)).alias("part_index", "text"))
    return parts.select(F.concat_ws(":", "item_index", "chunk_type", "part_index").alias("chunk_id"), "*")


def without_identifier(text: Column, identifier: Column) -> Column:
    """text with a space in the place of every occurrence of the identifier, taken literally and in any case; an empty or null one changes nothing."""
    literal = F.regexp_replace(identifier, r"([.*+?^$()|\[\]{}\\])", r"\\$1")
    return F.when(F.coalesce(identifier, F.lit("")) == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?iu)"), literal), F.lit(" ")))


def feature_query(features: Column, parts: int = 3, words: int = 36) -> Column:
    """A search request from the first distinct features, bounded in words; null where there are none."""
    bare = F.transform(F.filter(features, lambda f: f.isNotNull()), lambda f: F.regexp_replace(clean_text(f), r"^[ ,;:-]+|[ ,;:-]+$", ""))
    kept = F.filter(bare, lambda f: f != "")
    none = F.array().cast("array<string>")
    distinct = F.aggregate(kept, none, lambda a, f: F.when(F.exists(a, lambda o: F.lower(o) == F.lower(f)), a).otherwise(F.array_append(a, f)))
    text = F.array_join(F.slice(F.split(F.array_join(F.slice(distinct, 1, parts), " ; "), " "), 1, words), " ")
    return F.when(F.size(distinct) > 0, F.concat(F.lit("Looking for a product with these features: "), text))


def product_block(rank: Column, features: int = 5, description: int = 500) -> Column:
    """The facts of a product as labelled lines for a prompt; what is missing or invalid has no line, long parts are cut."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    listed = F.slice(clean_list(F.col("features")), 1, features)
    return F.concat_ws(
        "\n", F.concat(F.lit("[Product "), rank.cast("string"), F.lit("]")), F.concat(F.lit("Product ID: "), "parent_asin"), line("Title: ", clean_text(F.col("title"))),
        F.when(finite("price") & (F.col("price") > 0), F.concat(F.lit("Price: $"), F.format_string("%.2f", "price"))), F.when(finite("average_rating"), F.concat(F.lit("Average Rating: "), F.format_string("%.1f", "average_rating"), F.lit(" / 5"))),
        F.when(F.col("rating_number") >= 0, F.concat(F.lit("Rating Count: "), F.col("rating_number").cast("string"))), line("Store: ", clean_text(F.col("store"))), line("Categories: ", F.array_join(clean_list(F.col("categories")), " > ")),
        F.when(F.size(listed) > 0, F.concat(F.lit("Features:\n"), F.array_join(F.transform(listed, lambda f: F.concat(F.lit("- "), f)), "\n"))), line("Description: ", truncate_words(clean_text(F.col("description")), description)),
    )

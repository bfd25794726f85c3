"""Texts above a size limit, cut at natural boundaries with overlap.

The words' offsets are prefix sums of their lengths; boundaries are sorted arrays of such offsets, one per strength.
Each piece ends at the strongest boundary that a binary search finds below the limit, or at the limit itself, and the
next one begins at the first word within the overlap before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.session import spread

_SENTENCE = re.compile(r"[.!?…]+['\")\]»”’]*(?= )|[。！？]+[」』”’）]*")
_CLAUSE = re.compile(r"[,;:–—]['\")\]»”’]*(?= )|[、，；：]")
_BLOCK_END = re.compile(r"</(?:p|div|li|h[1-6]|ul|ol|tr|table|section)>|<br ?/?>", re.I)
#: A full stop behind these ends no sentence.
_SHORT = {"approx", "art", "no", "nos", "fig", "figs", "max", "min", "temp", "vs", "e.g", "i.e", "etc", "dr", "mr", "mrs", "ms", "st", "inc", "ltd", "co", "corp", "dept", "est", "vol", "ed", "pp", "p", "ca", "cf", "incl", "in", "ft", "oz", "lb", "lbs", "z.b", "bzw", "nr", "sr", "sra", "núm"}


def normalise(text: str) -> str:
    """Trimmed, every run of white space one space."""
    return " ".join(text.split())


def _abbreviates(whole: str, mark: re.Match) -> bool:
    """Whether the full stop belongs to an abbreviation or an initial."""
    if whole[mark.start()] != "." or mark.end() - mark.start() > 1:
        return False
    word = whole[whole.rfind(" ", 0, mark.start()) + 1 : mark.start()].lstrip("(\"'").lower()
    return word in _SHORT or (len(word) == 1 and word.isalpha())


def _whole_character(whole: str, start: int, at: int) -> int:
    """The place at or shortly before at that doesn't part a letter from its marks."""
    k = at
    while start + 1 < k < len(whole) and at - k < 16 and (unicodedata.combining(whole[k]) or whole[k] in "\u200d\ufe0f" or whole[k - 1] == "\u200d"):
        k -= 1
    return k if at - k < 16 else at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets (start, end) into normalise(text); one piece if it is within the limit, none if it is blank.

    Ends prefer, in this order, a line's end, a sentence's end and a clause's end in the latter half of the room, then
    any word's end, then the limit. Pieces cover the text; each begins at most overlap before its predecessor's end.
    """
    whole = normalise(text)
    n = len(whole)
    if n <= limit:
        return [(0, n)] if n else []
    ends = [k for k, c in enumerate(whole) if c == " "]
    starts = [0, *(k + 1 for k in ends)]
    sentences = [m.end() for m in _SENTENCE.finditer(whole) if not _abbreviates(whole, m)]
    clauses = [m.end() for m in _CLAUSE.finditer(whole)]
    lines = [m.end() for m in _BLOCK_END.finditer(whole)]
    if "\n" in text:
        at = 0
        for line in text.split("\n"):
            if size := len(normalise(line)):
                at += size + (at > 0)
                lines.append(at)
        lines.sort()
    # an overlap may begin at a word, or behind a mark in scripts without spaces
    starts = sorted({*starts, *(k for k in (*sentences, *clauses) if k < n and whole[k] != " ")})
    out, start = [], 0
    while n - start > limit:
        top = start + limit
        end = 0
        for boundaries, least in ((lines, limit // 2), (sentences, limit // 2), (clauses, limit // 2), (ends, overlap)):
            k = bisect_right(boundaries, top)
            if k and boundaries[k - 1] > start + least:
                end = boundaries[k - 1]
                break
        end = end or _whole_character(whole, start, top)
        out.append((start, end))
        # the first word start within the overlap; where a word spans it, a cut inside the word
        k = bisect_left(starts, max(end - overlap, start + 1))
        begin = starts[k] if k < len(starts) and starts[k] < end else end - overlap
        while begin < end and unicodedata.combining(whole[begin]):
            begin += 1
        if begin <= start:
            begin = end
        start = begin + (begin < n and whole[begin] == " ")
    out.append((start, n))
    return out


def split_texts(df: DataFrame, keep: list[str], text: str = "text", limit: int = 1600, overlap: int = 160) -> DataFrame:
    """keep, part_index, text, n_chars and n_overlap (characters shared with the piece before) of every piece of each text.

    Sizes are in code points of the text with its white space normalised. Null and blank texts have no piece; repeated
    rows are cut each on their own. Every text is cut where its row lies, without a shuffle, in time proportional to it.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    fields = {f.name: f for f in df.schema}
    schema = T.StructType([*(fields[k] for k in keep), T.StructField("part_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("n_overlap", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, texts, sizes, shared = [], [], [], [], []
            for r, t in enumerate(b.column(len(keep)).to_pylist()):
                if not t:
                    continue
                whole, last = normalise(t), 0
                for k, (a, z) in enumerate(pieces(t, limit, overlap)):
                    rows.append(r)
                    parts.append(k)
                    texts.append(whole[a:z])
                    sizes.append(z - a)
                    shared.append(max(0, last - a))
                    last = z
            columns = [c.take(pa.array(rows, pa.int32())) for c in b.columns[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(shared, pa.int32())], names=[*keep, "part_index", "text", "n_chars", "n_overlap"])

    return spread(df.select(*keep, df[text].alias("__text"))).mapInArrow(cut, schema)


def _joined(features: Column) -> Column:
    return F.array_join(F.filter(features, lambda x: x.isNotNull()), "\n")


def catalogue_chunks(catalogue: DataFrame, limit: int = 1600, overlap: int = 160) -> DataFrame:
    """(chunk_id, item_index, chunk_type, part_index, text, n_chars, n_overlap) of descriptions and joined features.

    chunk_id is item_index:chunk_type:part_index. Null entries of features are left out; a listing without a text of a
    type has no chunk of it.
    """
    kinds = F.explode(F.array(F.struct(F.lit("features").alias("chunk_type"), _joined(F.col("features")).alias("text")), F.struct(F.lit("description").alias("chunk_type"), F.col("description").alias("text")))).alias("x")
    texts = catalogue.select("item_index", kinds).select("item_index", "x.chunk_type", "x.text").filter("text is not null")
    parts = split_texts(texts, ["item_index", "chunk_type"], "text", limit, overlap)
    return parts.select(F.concat_ws(":", "item_index", "chunk_type", "part_index").alias("chunk_id"), "*")

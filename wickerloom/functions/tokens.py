"""Texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wickerloom.session import spread

#: Where the ranks lie unless a caller names another file.
RANKS = os.environ.get("WICKERLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """The keep columns and n_tokens, the size of the whole text; null and empty texts have size 0.

    Texts stay in their input split; nothing is shuffled and only the named columns are read.
    """
    fields = {f.name: f for f in df.schema}
    schema = T.StructType([*(fields[k] for k in keep), T.StructField("n_tokens", T.IntegerType())])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int32())], [*keep, "n_tokens"])

    return spread(df.select(*keep, df[text].alias("__text"))).mapInArrow(sizes, schema)


def within_budget(df: DataFrame, keep: list[str], sections: list[str], budget: int, path: str = RANKS) -> DataFrame:
    """The keep columns, text, n_tokens and cut: sections in their order of importance, a line each, as many tokens as the budget holds.

    The first section that doesn't fit whole is cut at a token, at most to nothing, and ends the text. Null and empty
    sections take no room. A piece of a character at the cut is left out.
    """
    fields = {f.name: f for f in df.schema}
    schema = T.StructType([*(fields[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("cut", T.BooleanType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)

        def one(parts: tuple) -> tuple[str, int, bool]:
            done: list[int] = []
            for p in parts:
                if p:
                    more = e.encode_ordinary(("\n" if done else "") + p)
                    if len(done) + len(more) > budget:
                        text = e.decode_bytes(done + more[: budget - len(done)]).decode("utf-8", "ignore").rstrip()
                        # cutting may leave more tokens than it took, as pieces merge otherwise
                        while (n := len(e.encode_ordinary(text))) > budget:
                            text = text[:-1]
                        return text, n, True
                    done += more
            text = e.decode(done)
            return text, len(done), False

        for b in batches:
            rows = [one(r) for r in zip(*(c.to_pylist() for c in b.columns[len(keep) :]))]
            columns = [*zip(*rows)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_())], [*keep, "text", "n_tokens", "cut"])

    return spread(df.select(*keep, *sections)).mapInArrow(fill, schema)

"""Sizes of texts in tokens; the tokenizer is the core's."""

from wickerloom.functions.tokens import RANKS, count_tokens, encoding

__all__ = ["RANKS", "count_tokens", "encoding"]

"""Encoding of the whole corpus with a public tokenizer.

Each text is encoded as a monoid: an element is (text, token ids) and two neighbours are joined by
re-encoding only a window around their boundary. The window grows until it starts and ends at a
cut that the tokenizer's own pre-splitting is bound to make, whatever stands on either side; the
ids outside the window are then provably those of the whole text. Halves are encoded recursively
down to leaves of bounded length, so the cost of one encoder call does not grow with the text.

Why such a cut is certain: the pre-splitting pattern of the byte-level tokenizers is
``'(s|t|re|...)| ?letters| ?digits| ?others|spaces not before a word|spaces``. At a single ASCII
space that has a non-space on both sides no piece can reach over the space from the left (every
piece that takes non-spaces ends before a space), and a piece that starts at the space does not
depend on what came before. A token never crosses a piece, so encoding left and right of the space
separately gives the ids of the whole.

Defined results: a null, empty text gives an empty list; strings that look like special tokens are
ordinary text; a lone surrogate cannot occur in a Spark string. Decoding concatenates up the tree
(see ``decode``).
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a leaf of the tree.
LEAF = 4096
#: First window to either side of a boundary, in characters; doubled until a certain cut is inside.
WINDOW = 64

_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """File of a public tokenizer; the folder is a parameter or that of the installed package."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", folder: str | None = None):
    """The byte-level encoder ``name`` in this Python process."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(f"{name}.tiktoken", folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_tree(text: str, encode: Callable[[str], list[int]], leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of ``text``: leaves are encoded alone, then neighbours are joined up the tree."""
    if len(text) <= leaf:
        return encode(text)

    def build(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return encode(text[a:b])
        mid = (a + b) // 2
        return join(a, mid, b, build(a, mid), build(mid, b))

    def join(a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        w = window
        while True:  # the last certain cut of the left window
            lo = max(a, mid - w)
            cuts = [m.start() for m in _CUT.finditer(text, lo, mid)]
            if cuts or lo == a:
                break
            w *= 2
        start = cuts[-1] if cuts else a
        w = window
        while True:  # the first certain cut of the right window
            hi = min(b, mid + w)
            m = _CUT.search(text, mid + 1, hi)
            if m or hi == b:
                break
            w *= 2
        stop = m.start() if m else b
        drop = len(encode(text[start:mid])) if start > a else len(left)
        skip = len(encode(text[mid:stop])) if stop < b else len(right)
        return left[: len(left) - drop] + encode(text[start:stop]) + right[skip:]

    return build(0, len(text))


def decode(parts: list[list[int]], name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Text of neighbouring id lists; bytes are joined before they are read as UTF-8."""
    enc = load(name, folder)
    return b"".join(enc.decode_bytes(p) for p in parts).decode("utf-8", "replace")


def encode_column(column: Column | str, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """``ARRAY<INT>`` of ids; an empty array for null and for empty text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(name, folder).encode_ordinary
        for texts in batches:
            yield pd.Series([encode_tree(t, enc) if t else [] for t in texts], dtype=object)

    return ids(F.col(column) if isinstance(column, str) else column)


def count_column(column: Column | str, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Number of ids, without sending the ids back to the JVM; 0 for null and empty text."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(name, folder).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode_tree(t, enc)) if t else 0 for t in texts], dtype="int32")

    return count(F.col(column) if isinstance(column, str) else column)


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; a narrow stage, one row in, one row out."""
    return documents.select("doc_id", encode_column("text", name, folder).alias("ids"))

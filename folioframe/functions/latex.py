"""Brace-aware predicates over field values.

A value and its *mask* travel side by side: the mask has the same length, and every character
inside braces, every brace and every escaped pair is replaced, so that plain regular expressions
over the mask see the top level only. Values without braces and backslashes are their own mask and
never leave the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import closing
from folioframe.schema import ABBREVIATIONS

INSIDE, ESCAPED = "\x01", "\x02"
_PIECE = re.compile(r"\\.?|[{}]|[^\\{}]+", re.S)
_STOP = re.compile(rf"\.(?=\s+[A-Z{ESCAPED}])")
_BEFORE = re.compile(r"[^\s~{}(),]*$")
_ABBREVIATION = frozenset(ABBREVIATIONS)


def depth_mask(value: str) -> str:
    """Mask of one value."""
    out, depth = [], 0
    for m in _PIECE.finditer(value):
        s = m[0]
        if s[0] == "\\":
            out.append(ESCAPED * len(s) if depth == 0 else INSIDE * len(s))
        elif s == "{" or s == "}":
            depth += 1 if s == "{" else -1
            out.append(INSIDE)
        else:
            out.append(s if depth == 0 else INSIDE * len(s))
    return "".join(out)


def sentence_end(value: str, mask: str) -> int:
    """Offset of a top-level full stop that ends a sentence, or -1.

    A stop after an initial, capitals or a known abbreviation is none.
    """
    for m in _STOP.finditer(mask):
        word = _BEFORE.search(value[: m.start()].rstrip("."))[0]
        if len(word) > 1 and not word.isupper() and word.lower().strip(".") not in _ABBREVIATION:
            return m.start()
    return -1


_PROFILE = T.StructType([T.StructField("mask", T.StringType()), T.StructField("stop", T.IntegerType())])


@F.pandas_udf(_PROFILE)
def _profile(values: pd.Series) -> pd.DataFrame:
    masks = [None if v is None else depth_mask(v) for v in values]
    return pd.DataFrame({"mask": masks, "stop": pd.Series([-1 if m is None else sentence_end(v, m) for v, m in zip(values, masks)], dtype="int32")})


def needs_profile(v: Column) -> Column:
    """Values with braces, backslashes or a possible sentence end."""
    return v.rlike(r"[{}\\]|\.\s+[A-Z]")


def profile(v: Column) -> Column:
    """``STRUCT<mask, stop>`` of a value; null for null."""
    python = _profile(F.when(needs_profile(v), v))
    plain = F.when(v.isNotNull(), F.struct(v.alias("mask"), F.lit(-1).alias("stop")))
    return F.when(needs_profile(v), python).otherwise(plain)


def top_colons(p: Column) -> Column:
    """Number of colons before a space at the top level."""
    return F.regexp_count(p["mask"], F.lit(": "))


def terminal_marks(p: Column) -> Column:
    """Number of top-level question and exclamation marks."""
    return F.regexp_count(p["mask"], F.lit("[?!]"))


def would_split(etype: Column, v: Column, p: Column) -> Column:
    """Whether a title is one that splitting would act on."""
    return (
        F.when(etype == "review", False)
        .when(top_colons(p) == 1, True)
        .when((top_colons(p) > 1) | v.contains(": "), False)
        .when(p["stop"] >= 0, False)
        .otherwise(p["mask"].rlike(rf"[?!](?=\s+[A-Z{ESCAPED}])") & (terminal_marks(p) == 1))
    )


def words(v: Column) -> Column:
    """Number of words without macros and braces."""
    plain = F.regexp_replace(F.regexp_replace(v, r"\\[A-Za-z]+\s*", " "), "[{}]", " ")
    return F.size(F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != ""))


def hoistable(v: Column) -> Column:
    """A colon or terminal mark with text after it, inside macros as well."""
    return v.rlike(r"(?s)[:?!](?!\s*\}*\s*\}*\s*$)")


def keeps_shorttitle(etype: Column, v: Column, p: Column) -> Column:
    """Whether a short title is earned."""
    return (
        F.when(etype == "review", v.contains(":") | F.replace(v, F.lit(" ")).contains("\\bibstring{by"))
        .when(words(v) <= 6, False)
        .when(would_split(etype, v, p), False)
        .otherwise(hoistable(v) | (p["stop"] >= 0))
    )


def shorttitle_verdict(etype: Column, v: Column, p: Column, split: Column) -> Column:
    """earned, redundant or deferred."""
    return F.when(~split & keeps_shorttitle(etype, v, p), "earned").when(split | (top_colons(p) == 0), "redundant").otherwise("deferred")


def flattened(v: Column) -> Column:
    """Comparable form: no markup, one space, lower case, no closing punctuation."""
    return F.rtrim(F.lower(F.trim(F.regexp_replace(F.regexp_replace(v, r"[{}\\]", ""), r"\s+", " "))), F.lit(".,;:?!"))


def stripped(s: str) -> str:
    """``strip_latex`` of one value nested to any depth."""
    before = None
    while before != s:
        before = s
        for pattern, new in _STRIP:
            s = re.sub(pattern, new, s)
    return s


_STRIP = ((r"\\(?:foreignlanguage|hyphenation)\s*\{[^{}]*\}", ""), (r"\\bibstring\s*\{[^{}]*\}", ""), (r"\\[A-Za-z]+\*?\s*\{([^{}]*)\}", r"\1"))


@F.pandas_udf(T.StringType())
def _stripped(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else stripped(s))


def strip_latex(v: Column, depth: int = 6) -> Column:
    """Text of a value: first arguments of language macros and bibstrings dropped, other macros unwrapped, no braces.

    Values nested deeper than ``depth`` are finished in Python; all others stay in the JVM.
    """
    out = v
    for _ in range(depth):
        out = F.regexp_replace(out, r"\\(?:foreignlanguage|hyphenation)\s*\{[^{}]*+\}", "")
        out = F.regexp_replace(out, r"\\bibstring\s*\{[^{}]*+\}", "")
        out = F.regexp_replace(out, r"\\[A-Za-z]+\*?\s*\{([^{}]*+)\}", "$1")
    deeper = out.rlike(r"\\[A-Za-z]+\*?\s*\{[^{}]*\}")
    out = F.when(deeper, _stripped(F.when(deeper, out))).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\\bibstring\b|[{}]", ""), r"\s+", " "))


def unwrap(v: Column) -> Column:
    """Payload of a macro that wraps the whole value; payloads of more than three nested groups are read in Python."""
    group = r"(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{[^{}]*+\})*+\})*+"
    whole, head = F.trim(v), r"\\(?:foreignlanguage\{[a-zA-Z]+\}|mkbibquote|mkbibemph)\{"
    deep = whole.rlike(rf"(?s)^{head}.*\{{[^{{}}]*\{{[^{{}}]*\{{.*\}}$")
    return F.when(deep, _unwrapped(F.when(deep, whole))).otherwise(F.regexp_replace(whole, rf"(?s)^{head}({group})\}}$", "$1"))


@F.pandas_udf(T.StringType())
def _unwrapped(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unwrapped(s))


def unwrapped(s: str) -> str:
    """``unwrap`` of one value of any depth."""
    head = re.match(r"\\(?:foreignlanguage\{[a-zA-Z]+\}|mkbibquote|mkbibemph)\{", s)
    return s[head.end() : -1] if head and closing(s, head.end() - 1) == len(s) - 1 else s


def looks_english(v: Column, markers: list[str]) -> Column:
    """At least two English function words."""
    plain = F.regexp_replace(F.regexp_replace(v, r"\\[A-Za-z]+|[{}]", " "), "[^A-Za-z' ]", " ")
    known = F.array(*map(F.lit, markers))
    return F.size(F.filter(F.split(F.lower(plain), " +"), lambda w: F.array_contains(known, w))) >= 2


def repeated_run(v: Column, n: int = 5) -> Column:
    """Whether a run of ``n`` words stands twice in a value."""
    w = F.filter(F.split(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " "), " "), lambda x: x != "")

    def twice(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) > n, F.size(F.array_distinct(runs)) < F.size(runs)).otherwise(False)

    # the words are bound once; written out they would be split again for every run
    return F.when(v.isNotNull(), F.get(F.transform(F.array(w), twice), F.lit(0)))

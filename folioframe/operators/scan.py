"""Scanner of library files: entries, fields and opaque spans with exact code-point offsets.

One document in, many rows out, inside an Arrow batch; documents are independent, so the stage is
narrow. A tokeniser runs once over each document and keeps a stack-free state (depth, quoting);
spans are cut from its events. Entries, comments and text between entries tile the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from folioframe.schema import SCANNED

_HEAD = re.compile(r"^@([A-Za-z]+)\s*\{", re.M)
_EVENT = re.compile(r'\\.?|[{}",]', re.S)
_NAME = re.compile(r"\s*([A-Za-z][A-Za-z0-9_+:-]*)\s*=\s*")
OPAQUE = frozenset(("comment", "preamble", "string"))
#: Rows, and characters of their text, that leave the scanner at once.
BLOCK_ROWS, BLOCK_CHARS = 500, 1_000_000


def _body(text: str, at: int, stop: int | None = None) -> tuple[int | None, list[int]]:
    """End of the group that opens at ``at`` (None if unbalanced before ``stop``), and its top-level commas; nothing is copied."""
    depth, quoted, commas = 0, False, []
    for m in _EVENT.finditer(text, at, len(text) if stop is None else stop):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return m.start(), commas
        elif depth == 1:
            if c == '"':
                quoted = not quoted
            elif c == "," and not quoted:
                commas.append(m.start())
    return None, commas


def _value(text: str, start: int, end: int) -> tuple[int, int]:
    """Span of the value inside its delimiters; ``start`` is after the equals sign."""
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end and text[start] == "{":
        close, _ = _body(text, start, end)
        return start + 1, end if close is None else close
    if start < end and text[start] == '"':
        close = text.find('"', start + 1, end)
        return start + 1, end if close < 0 else close
    return start, end


def scan(text: str) -> list[dict]:
    """Entries and opaque spans of a document, in order."""
    return list(spans(text))


def spans(text: str) -> Iterator[dict]:
    """The rows of ``scan`` one by one, so that a document's rows need never be in memory together."""
    for i, row in enumerate(_spans(text)):
        row["ord"] = i
        yield row


def _opaque(a: int, b: int) -> Iterator[dict]:
    if b > a:
        yield {"kind": "opaque", "etype": None, "citekey": None, "start": a, "end": b, "fields": []}


def _spans(text: str) -> Iterator[dict]:
    pos = 0
    for head in _HEAD.finditer(text):
        if head.start() < pos:
            continue
        yield from _opaque(pos, head.start())
        brace = head.end() - 1
        close, commas = _body(text, brace)
        if close is None:
            yield from _opaque(head.start(), len(text))
            return
        etype = head[1].lower()
        if etype in OPAQUE:
            yield from _opaque(head.start(), close + 1)
        else:
            cuts = [*commas, close]
            fields = []
            for a, b in zip(cuts, cuts[1:]):
                m = _NAME.match(text, a + 1, b)
                if m:
                    vs, ve = _value(text, m.end(), b)
                    fields.append({"ord": len(fields), "name": m[1], "key": m[1].lower(), "value": text[vs:ve], "lead": text[a + 1 : m.start(1)], "start": a + 1, "end": b, "vstart": vs, "vend": ve})
            yield {"kind": "entry", "etype": etype, "citekey": text[brace + 1 : cuts[0]].strip(), "start": head.start(), "end": close + 1, "fields": fields}
        pos = close + 1
    yield from _opaque(pos, len(text))


def blocks(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Rows in lists of at most ``BLOCK_ROWS`` rows that end at ``BLOCK_CHARS`` characters of text."""
    block, chars = [], 0
    for r in rows:
        block.append(r)
        chars += r["end"] - r["start"]
        if len(block) == BLOCK_ROWS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def scan_documents(docs: DataFrame) -> DataFrame:
    """Scanned rows of documents (doc, text); a null text gives none."""

    schema = to_arrow_schema(_parse_datatype_string(SCANNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch holds the texts of many documents: one text is read at a time, and its rows leave in blocks
        rows = ({"doc": b["doc"][i].as_py(), **r} for b in batches for i in range(len(b)) if b["text"][i].is_valid for r in spans(b["text"][i].as_py()))
        for block in blocks(rows):
            yield pa.RecordBatch.from_pylist(block, schema)

    return docs.select("doc", "text").mapInArrow(run, SCANNED)


def entries(scanned: DataFrame) -> DataFrame:
    """Entries with ``f`` (key to value) and ``g`` (key to field with its spans); the first of a repeated key counts."""
    e = scanned.filter("kind = 'entry'")
    return with_field_map(e)


def with_field_map(e: DataFrame) -> DataFrame:
    keys = F.transform("fields", lambda x: x["key"])
    first = F.filter("fields", lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    g = F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"], x)))
    return e.withColumn("f", F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"], x["value"])))).withColumn("g", g)


def field_rows(scanned: DataFrame) -> DataFrame:
    """One row per field."""
    return scanned.filter("kind = 'entry'").select("doc", "ord", "etype", "citekey", F.explode("fields").alias("x")).select(
        "doc", F.col("ord").alias("entry_ord"), "etype", "citekey", F.col("x.ord").alias("field_ord"), "x.name", "x.key", "x.value", "x.start", "x.end", "x.vstart", "x.vend"
    )


def tiles(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc, ok): whether the spans of every document tile it without gap or overlap."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("start", "end")
    s = scanned.select("doc", "start", "end", F.lag("end", 1, 0).over(w).alias("before"))
    agg = s.groupBy("doc").agg(F.bool_and(F.col("before") == F.col("start")).alias("close"), F.max("end").alias("last"))
    n = F.length("text")
    return docs.select("doc", n.alias("n")).join(agg, "doc", "left").select("doc", F.coalesce(F.col("close") & (F.col("last") == F.col("n")), F.col("n") == 0).alias("ok"))


def swallowed_fields(scanned: DataFrame) -> DataFrame:
    """Fields whose span holds a second field header: a comma is missing before it."""
    rows = field_rows(scanned)
    return rows.filter(F.regexp_replace("value", r"\\.", "  ").rlike(r"\n\s*[A-Za-z][-A-Za-z0-9]*\s*=\s*[{\"]"))

"""Rendering of entries to library text, and splicing of edits into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_text(etype: Column, citekey: Column, fields: Column) -> Column:
    """One entry: tab-indented, a field per line; ``fields`` has name and value."""
    lines = F.array_join(F.transform(fields, lambda x: F.concat(F.lit(",\n\t"), x["name"], F.lit(" = {"), x["value"], F.lit("}"))), "")
    return F.concat(F.lit("@"), etype, F.lit("{"), citekey, lines, F.lit("}\n"))


def _placed(entries: DataFrame, per_document: int) -> DataFrame:
    """(doc, entry_ord, t) of entries (path, entry_ord, etype, citekey, fields)."""
    block = F.floor(F.col("entry_ord") / per_document).cast("int")
    return entries.select(F.concat_ws("#", "path", block.cast("string")).alias("doc"), "entry_ord", entry_text(F.col("etype"), F.col("citekey"), F.col("fields")).alias("t"))


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", "t"))), lambda x: x["t"]), "\n").alias("text")


def documents(entries: DataFrame, per_document: int = 500) -> DataFrame:
    """(doc, text) of entries (path, entry_ord, etype, citekey, fields): blocks of a path, so no document grows with its path."""
    return _placed(entries, per_document).groupBy("doc").agg(_joined())


def pieces(entries: DataFrame, per_document: int = 500) -> DataFrame:
    """``documents``, of which those with more than ``per_document`` entries are cut into pieces with a number behind the name.

    Only where several entries stand at one place of a path is there more than one piece; without them such a
    document grows with the number of its copies, and an executor holds it whole, as rows and as text.
    """
    w = Window.partitionBy("doc").orderBy("entry_ord", "t")
    piece = F.floor((F.row_number().over(w) - 1) / per_document).cast("int")
    cut = _placed(entries, per_document).withColumn("piece", piece).groupBy("doc", "piece").agg(_joined())
    return cut.select(F.concat_ws(".", "doc", F.when(F.col("piece") > 0, F.col("piece").cast("string"))).alias("doc"), "text")


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, text, overlap): every document with its edits (doc, start, end, text) spliced in.

    Edits of one document are sorted and woven between the untouched slices in one forward pass;
    a document with overlapping edits is returned unchanged with ``overlap`` true.
    """
    e = edits.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("new")))).alias("es"))
    j = docs.join(e, "doc", "left").withColumn("es", F.coalesce("es", F.expr("cast(array() as array<struct<start:int,end:int,new:string>>)")))
    ends = F.transform("es", lambda x: x["end"])
    bad = F.exists(F.transform("es", lambda x, i: (i > 0) & (x["start"] < F.coalesce(F.get(ends, i - 1), F.lit(0)))), lambda x: x)
    slices = F.transform("es", lambda x, i: F.concat(F.expr("''"), F.substring("text", F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, x["start"] - F.coalesce(F.get(ends, i - 1), F.lit(0))), x["new"]))
    tail = F.substring(F.col("text"), F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) + 1, F.length("text"))
    return j.select("doc", F.when(bad, F.col("text")).otherwise(F.concat(F.array_join(slices, ""), tail)).alias("text"), bad.alias("overlap"))


def template(entries: DataFrame, picks: DataFrame, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """Picked entries (citekey, ord, why) as template text with capitalised field names, and the picks that no entry has.

    ``entries`` has citekey, etype and fields; bookkeeping fields in ``drop`` are left out.
    """
    j = picks.join(entries.select("citekey", "etype", "fields"), "citekey")
    kept = F.transform(F.filter("fields", lambda x: ~x["key"].isin(*drop)), lambda x: F.struct(F.initcap(x["key"]).alias("name"), x["value"].alias("value")))
    head = F.concat(F.lit("% --- "), F.col("why"), F.lit("\n"))
    text = j.select("ord", F.concat(head, entry_text(F.col("etype"), F.col("citekey"), kept)).alias("text"))
    return text, picks.join(entries.select("citekey"), "citekey", "left_anti")

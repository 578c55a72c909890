"""Safety gates between a library before and after a rewrite; each gives the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.scan import field_rows, swallowed_fields
from folioframe.schema import NORMALIZE_PROTECTED


def _ordered(scanned: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("ord")
    return scanned.filter("kind = 'entry'").select("doc", "citekey", F.row_number().over(w).alias("n"))


def count_changed(before: DataFrame, after: DataFrame, dropped: int = 0) -> DataFrame:
    """Documents whose number of entries changed by more than the named drops."""
    n = lambda d, c: d.filter("kind = 'entry'").groupBy("doc").agg(F.count("*").alias(c))
    return n(before, "b").join(n(after, "a"), "doc", "full_outer").fillna(0, ["a", "b"]).filter(F.col("b") - dropped != F.col("a"))


def citekey_order(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions where the citekeys differ."""
    a, b = _ordered(after).withColumnRenamed("citekey", "key_after"), _ordered(before)
    return b.join(a, ["doc", "n"], "full_outer").filter(~F.col("citekey").eqNullSafe(F.col("key_after")))


def opaque_changed(docs_before: DataFrame, before: DataFrame, docs_after: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks that are no entries and differ."""

    def blocks(docs: DataFrame, scanned: DataFrame) -> DataFrame:
        o = scanned.filter("kind = 'opaque'").join(docs, "doc")
        t = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
        return o.select("doc", t.alias("t")).filter(F.trim("t").startswith("@")).groupBy("doc", "t").count()

    b, a = blocks(docs_before, before), blocks(docs_after, after)
    return b.exceptAll(a).unionAll(a.exceptAll(b))


def protected_changed(before: DataFrame, after: DataFrame, pattern: str = NORMALIZE_PROTECTED) -> DataFrame:
    """Protected fields in one version and not in the other."""
    pick = lambda d: field_rows(d).filter(F.col("key").rlike(pattern)).groupBy("doc", "citekey", "key", "value").count()
    b, a = pick(before), pick(after)
    return b.exceptAll(a).withColumn("side", F.lit("before")).unionAll(a.exceptAll(b).withColumn("side", F.lit("after")))


def newly_swallowed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields that now hold another field's header."""
    return swallowed_fields(after).join(swallowed_fields(before).select("doc", "citekey", "key"), ["doc", "citekey", "key"], "left_anti")


def doubled_commas(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Entries with two commas and nothing between them outside of values."""
    e = scanned.filter("kind = 'entry'").join(docs, "doc")
    ends = F.transform("fields", lambda x: x["end"])
    gaps = F.transform("fields", lambda x, i: F.substring("text", F.coalesce(F.get(ends, i - 1), F.col("start")) + 1, x["start"] - F.coalesce(F.get(ends, i - 1), F.col("start"))))
    tail = F.substring("text", F.coalesce(F.get(ends, F.size(ends) - 1), F.col("end")) + 1, F.lit(64))
    return e.filter(F.exists(gaps, lambda g: g.rlike(r",\s*,$")) | tail.rlike(r"^,\s*,")).select("doc", "ord", "citekey")


def length_law(docs_before: DataFrame, docs_after: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents whose length isn't the old one plus the edits' difference."""
    d = edits.groupBy("doc").agg(F.sum(F.length("text") - (F.col("end") - F.col("start"))).alias("delta"))
    b, a = docs_before.select("doc", F.length("text").alias("b")), docs_after.select("doc", F.length("text").alias("a"))
    return b.join(a, "doc", "full_outer").join(d, "doc", "left").filter(~(F.col("b") + F.coalesce("delta", F.lit(0))).eqNullSafe(F.col("a")))


def bad_bytes(files: DataFrame) -> DataFrame:
    """Files (doc, content BINARY) that are not UTF-8 or hold carriage returns."""
    t = F.col("content").cast("string")
    return files.filter(~F.is_valid_utf8(t) | t.contains("\r")).select("doc")


def unnamed_changed(docs_before: DataFrame, before: DataFrame, docs_after: DataFrame, after: DataFrame, named: DataFrame) -> DataFrame:
    """Entries that no operation names and that are not the same text in both versions."""

    def texts(docs: DataFrame, scanned: DataFrame) -> DataFrame:
        e = scanned.filter("kind = 'entry'").join(docs, "doc").join(named.select("citekey").distinct(), "citekey", "left_anti")
        return e.select("doc", "citekey", F.sha2(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), 256).alias("h")).groupBy("doc", "citekey", "h").count()

    b, a = texts(docs_before, before), texts(docs_after, after)
    return b.exceptAll(a).unionAll(a.exceptAll(b))

"""Writers: placement of saved entries, versions of a library, dead letters and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import braces_verdict, cleaned_reply

_GROUPS = "@comment{BibDesk Static Groups{"


def saved(library: Column, entry: Column) -> Column:
    """Library text with an entry before its static groups, or at the end."""
    at = F.instr(library, _GROUPS)
    head, tail = F.substring(library, F.lit(1), at - 1), F.substring(library, at, F.length(library))
    body = F.concat(F.trim(entry), F.lit("\n\n"))
    return F.when(at > 0, F.concat(head, body, tail)).otherwise(F.concat(F.rtrim(library, F.lit("\n")), F.lit("\n\n"), body))


def prepared(replies: DataFrame) -> DataFrame:
    """Replies (id, source, reply, missing) with the entry to save, its comments, status and error.

    An entry must begin with @ and balance its braces; what it still misses is a comment before it.
    """
    e = replies.withColumn("entry", cleaned_reply(F.col("reply")))
    verdict = braces_verdict(F.col("entry"))
    error = F.when(~F.coalesce(F.col("entry"), F.lit("")).startswith("@"), "no entry").when(verdict != "ok", verdict)
    marks = F.concat_ws("\n", F.concat(F.lit("% Source: "), F.col("source")), F.when(F.size("missing") > 0, F.concat(F.lit("% INCOMPLETE: missing "), F.array_join("missing", ", "))))
    return e.select("id", "source", F.concat_ws("\n", marks, "entry").alias("text"), F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"), (F.size("missing") > 0).alias("needs_review"))


def dead_letters(rows: DataFrame) -> DataFrame:
    """Text of the failed ones, with source and error."""
    return rows.filter("error IS NOT NULL").select("id", F.concat(F.lit("% FAILED\n% Source: "), "source", F.lit("\n% Error: "), "error", F.lit("\n\n")).alias("text"))


def write_version(docs: DataFrame, path: str) -> None:
    """Write documents (doc, text) beside the originals; an existing version is never overwritten."""
    docs.select("doc", "text").write.mode("error").parquet(path)


def write_scores(totals: DataFrame, rows: DataFrame, path: str) -> None:
    totals.write.mode("error").json(f"{path}/stats")
    rows.write.mode("error").json(f"{path}/rows")

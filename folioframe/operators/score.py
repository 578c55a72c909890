"""Scoring extraction runs against curated truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import scored_value

IGNORED = ["date-added", "date-modified", "keywords"]


def compared(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(n, cfg, key, verdict): match, differ, missing or extra for every field of every item and run.

    ``truth`` has n, key, value; ``got`` has n, cfg, key, value. One full outer join on (n, cfg, key).
    """
    runs = got.select("n", "cfg").distinct()
    t = truth.filter(~F.col("key").isin(*IGNORED)).join(runs, "n").select("n", "cfg", "key", F.col("value").alias("t"))
    g = got.filter(~F.col("key").isin(*IGNORED)).select("n", "cfg", "key", F.col("value").alias("g"))
    j = t.join(g, ["n", "cfg", "key"], "full_outer")
    verdict = F.when(F.col("g").isNull(), "missing").when(F.col("t").isNull(), "extra").when(scored_value(F.col("t")) == scored_value(F.col("g")), "match").otherwise("differ")
    return j.select("n", "cfg", "key", verdict.alias("verdict"))


def totals(cmp: DataFrame) -> DataFrame:
    """Per run: truth fields, matches, differences, missing and extra fields, and the value accuracy."""
    c = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    t = F.count_if(F.col("verdict") != "extra")
    return cmp.groupBy("cfg").agg(t.alias("truth"), c("match"), c("differ"), c("missing"), c("extra"), F.try_divide(F.count_if(F.col("verdict") == "match"), t).alias("accuracy"))


def field_errors(cmp: DataFrame) -> DataFrame:
    """Missing and different values per run and field."""
    return cmp.groupBy("cfg", "key").agg(F.count_if(F.col("verdict") == "missing").alias("n_missing"), F.count_if(F.col("verdict") == "differ").alias("n_differ"))


def worst_fields(cmp: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` fields with most errors per run."""
    e = field_errors(cmp).withColumn("errors", F.col("n_missing") + F.col("n_differ"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("cfg").orderBy(F.desc("errors"), "key"))).filter(F.col("rank") <= k)


def coverage(truth: DataFrame, got: DataFrame, fields: list[str]) -> DataFrame:
    """(key, cfg, expected, present): how many of the items that should have a field have it."""
    t = truth.filter(F.col("key").isin(*fields)).select("n", "key").distinct().join(got.select("n", "cfg").distinct(), "n")
    g = got.filter(F.col("key").isin(*fields) & (F.coalesce("value", F.lit("")) != "")).select("n", "cfg", "key").distinct().withColumn("has", F.lit(1))
    return t.join(g, ["n", "cfg", "key"], "left").groupBy("key", "cfg").agg(F.count("*").alias("expected"), F.count("has").alias("present"))


def type_accuracy(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(cfg, items, type_ok) from truth (n, etype) and got (n, cfg, etype); a failed item has a null type."""
    j = got.join(truth.select("n", F.col("etype").alias("t")), "n")
    return j.groupBy("cfg").agg(F.count("*").alias("items"), F.count_if(F.lower("etype") == F.lower("t")).alias("type_ok"))

"""Completing and verifying records against a catalogue, with the source of every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text, web
from folioframe.schema import BOOK_LIKE

FILLED = ["volume", "number", "pages", "publisher", "journaltitle"]


def lookup(entries: DataFrame, works: DataFrame) -> DataFrame:
    """Entries with ``work``: found by exact DOI, else by the best title.

    ``entries`` has id, etype, f (map); ``works`` has doi, title, author, year, fields (map). The
    title search is an equi-join on the comparable title, gated by author and year; among equals
    the smallest DOI counts. Both lookups are joins on keys, so nothing is compared all to all.
    """
    e = entries.withColumn("k_doi", F.lower(F.col("f")["doi"])).withColumn("k_title", F.nullif(text.comparable(F.col("f")["title"]), F.lit("")))
    w = works.withColumn("w", F.struct("doi", "fields"))
    by_doi = w.select(F.lower("doi").alias("k_doi"), F.col("w").alias("w_doi")).dropDuplicates(["k_doi"])
    surname = F.split_part(F.col("f")["author"], F.lit(","), F.lit(1))
    year = F.substring(F.col("f")["date"], 1, 4).try_cast("int")
    titled = e.join(w.select(text.comparable(F.col("title")).alias("k_title"), "author", F.col("year").alias("w_year"), F.col("w").alias("w_title")), "k_title")
    titled = titled.filter(web.surname_found(F.col("author"), surname) & web.year_near(F.col("w_year"), year))
    best = titled.groupBy("id").agg(F.min_by("w_title", F.col("w_title")["doi"]).alias("w_title"))
    j = e.join(by_doi, "k_doi", "left").join(best, "id", "left")
    method = F.when(F.col("w_doi").isNotNull(), "doi").when(F.col("w_title").isNotNull(), "title")
    return j.select("id", "etype", "f", F.coalesce("w_doi", "w_title").alias("work"), method.alias("match_method"))


def filled(looked_up: DataFrame) -> DataFrame:
    """(id, key, value, source): fields that the catalogue adds; existing values are never overwritten, a publisher only for book-like types."""
    work = F.col("work")["fields"]
    item = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), work[k].alias("value")) for k in FILLED))).alias("x")
    rows = looked_up.filter("work IS NOT NULL").select("id", "etype", "f", "match_method", item)
    new = (F.coalesce(F.col("x.value"), F.lit("")) != "") & (F.coalesce(F.element_at("f", F.col("x.key")), F.lit("")) == "")
    allowed = (F.col("x.key") != "publisher") | F.col("etype").isin(*BOOK_LIKE)
    return rows.filter(new & allowed).select("id", "x.key", "x.value", F.concat(F.lit("catalogue/"), F.col("match_method")).alias("source"))


def provenance(rows: DataFrame) -> DataFrame:
    """(id, note): the filled fields of a record by source, sorted."""
    g = rows.groupBy("id", "source").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))
    return g.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "source", "keys"))), "; ").alias("note"))


def decision(field: Column, claimed: Column, verified: Column, by_doi: Column) -> Column:
    """ok, candidate or unconfirmed for one claimed field against the catalogue's value."""
    names = field.isin("author", "editor")
    same = text.comparable(claimed) == text.comparable(verified)
    more = F.when(names, web.is_name_completion(claimed, verified)).otherwise(F.lower(verified).contains(F.lower(claimed)) & (claimed != ""))
    return F.when(F.coalesce(verified, F.lit("")) == "", "unconfirmed").when(same, "ok").when(by_doi & more, "candidate").otherwise("unconfirmed")


def top_candidate(pairs: DataFrame, least: float = 0.72) -> DataFrame:
    """Best candidate per id from (id, rank, score, ...): at least ``least``, the first of equal scores."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "rank")
    return pairs.filter(F.col("score") >= least).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def unexpected(merged: Column, existing: Column, candidates: Column) -> Column:
    """Fields of a merged record that are neither its own nor candidates, sorted."""
    return F.array_sort(F.array_except(merged, F.array_union(existing, candidates)))

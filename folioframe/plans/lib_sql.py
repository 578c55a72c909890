"""The library that the queries work on: SQL text that Spark and DuckDB both run.

All records of ``bib_entry`` with all their fields of ``bib_field`` (each once, however often it was
delivered), plus fields with known defects by number, so that every rule has cases. ``{bib_entry}``
and ``{bib_field}`` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import render, scan
from folioframe.session import table

#: (position, name, condition, value): the added fields.
ADDED = [
    (101, "doi", "entry_id % 5 = 0", "concat('10.5555/x.', cast(entry_id AS VARCHAR(20)))"),
    (102, "isbn", "entry_id % 11 = 0", "'978-0-00'"),
    (103, "issn", "entry_id % 23 = 0", "'0000-0000'"),
    (104, "Shorttitle", "entry_id % 4 = 0 AND title IS NOT NULL", "CASE WHEN entry_id % 8 = 0 THEN title ELSE replace(replace(replace(substr(title, 1, 12), chr(123), ''), chr(125), ''), chr(92), '') END"),
    (105, "subtitle", "entry_id % 13 = 0", "'A Second Half, 3-7'"),
    (106, "booktitle", "etype IN ('incollection', 'inproceedings')", "CASE WHEN entry_id % 2 = 0 THEN 'Essays on Method: Part One' ELSE concat('Why Not? A Debate on ', chr(123), 'Method: Two', chr(125)) END"),
    (107, "series", "entry_id % 7 = 0", "CASE WHEN entry_id % 21 = 0 THEN 'Studien, Bd. 4' ELSE 'Studies in Examples' END"),
    (108, "issuetitle", "entry_id % 17 = 0", "'49'"),
    (109, "urldate", "entry_id % 6 = 0", "CASE WHEN entry_id % 12 = 0 THEN '2020-01-02--2020-01-05' ELSE '2020-01-02' END"),
    (110, "volumes", "entry_id % 19 = 0", "CASE WHEN entry_id % 38 = 0 THEN '1-5' ELSE '3' END"),
    (111, "note", "entry_id % 29 = 0", "'Eﬃcient (a draft'"),
    (112, "titleaddon", "entry_id % 31 = 0", "concat('na', chr(92), '\"', chr(123), 'i', chr(125), 've ', chr(92), 'reviewof', chr(123), 'X', chr(125), ' ', chr(92), 'foreignlanguage', chr(123), 'french', chr(125), ' text')"),
    (113, "year", "entry_id % 37 = 0", "'1999'"),
    (114, "date-modified", "entry_id % 3 <> 0", "'2020-01-01 00:00:00 +0000'"),
    (115, "bdsk-url-1", "entry_id % 2 = 0", "concat('https://mirror.example/', cast(entry_id AS VARCHAR(20)))"),
]

_ADDED_SQL = " UNION ALL ".join(f"SELECT entry_id, {o} AS field_ord, '{n}' AS name, {v} AS value FROM {{bib_entry}} WHERE {c}" for o, n, c, v in ADDED)
FIELDS_SQL = (
    "SELECT entry_id, field_ord, name, lower(name) AS key, value FROM ("
    "SELECT entry_id, field_ord, min(field_name) AS name, min(field_value) AS value FROM {bib_field} GROUP BY entry_id, field_ord "
    f"UNION ALL {_ADDED_SQL}) q WHERE value IS NOT NULL"
)
#: DuckDB's start of every oracle: ``lib`` (fields), ``ent`` (entries) and ``m`` (fields by key).
PIVOTED = "title booktitle maintitle subtitle booksubtitle shorttitle date year url urldate doi pages volume number volumes keywords series issuetitle langid titleaddon note author publisher".split()
_FIRST = ", ".join(f"min_by(value, field_ord) FILTER (WHERE key = '{k}') AS f_{k}" for k in PIVOTED)
DUCK = (
    "WITH lib AS (" + FIELDS_SQL.format(bib_entry="bib_entry", bib_field="bib_field").replace("VARCHAR(20)", "VARCHAR") + "), "
    "m AS (SELECT e.entry_id, any_value(e.path) AS path, any_value(e.entry_ord) AS entry_ord, any_value(e.etype) AS etype, any_value(e.citekey) AS citekey, "
    + _FIRST + " FROM bib_entry e LEFT JOIN lib USING (entry_id) GROUP BY e.entry_id) "
)


def lib_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, field_ord, name, key, value)."""
    sql = FIELDS_SQL.replace("VARCHAR(20)", "STRING")
    return spark.sql(sql, bib_entry=table(spark, sf_dir, "bib_entry"), bib_field=table(spark, sf_dir, "bib_field"))


def lib_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, entry_ord, etype, citekey, fields) of every record, from the tables."""
    f = lib_fields(spark, sf_dir).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("field_ord", "name", "key", "value"))).alias("fields"))
    e = table(spark, sf_dir, "bib_entry").select("entry_id", "path", "entry_ord", "etype", "citekey")
    return e.join(f, "entry_id")


def lib_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): the library as text."""
    return render.documents(lib_entries(spark, sf_dir))


def lib_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's text in pieces of bounded length, scanned."""
    return scan.scan_documents(render.pieces(lib_entries(spark, sf_dir)))


def lib_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the scanned library."""
    return scan.entries(lib_scanned(spark, sf_dir))

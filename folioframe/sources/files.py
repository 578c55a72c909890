"""Readers: library files, bookmarks, patch lists, manifests, and a data source named ``bib``."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioframe.functions.text import key_pages
from folioframe.schema import PATCH


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text, content, error) of the ``.bib`` files below a path; bytes that aren't UTF-8 are an error, not a failure."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.bib").option("recursiveFileLookup", "true").load(path)
    t = F.col("content").cast("string")
    ok = F.is_valid_utf8(t)
    return f.select(F.col("path").alias("doc"), F.when(ok, t).alias("text"), "content", F.when(~ok, "not UTF-8").alias("error"))


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content, error) of the input files of a folder, by path; unknown suffixes are errors."""
    f = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix == "webloc", "webloc")
    return f.select("path", kind.alias("kind"), "content", F.when(kind.isNull(), F.concat(F.lit("no extractor for ."), suffix)).alias("error")).orderBy("path")


@F.pandas_udf(T.StringType())
def bookmark_url(content: pd.Series) -> pd.Series:
    """Address of a bookmark file, XML or binary; null if it holds none."""

    def url(b):
        try:
            v = plistlib.loads(b).get("URL") if b else None
        except Exception:  # noqa: BLE001 - an unreadable bookmark has no address
            return None
        return v if isinstance(v, str) and v else None

    return content.map(url)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch operations in the order of the list."""
    kind = "array<struct<op:string,key:string,field:string,value:string,why:string>>"
    ops = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("at", "o"))
    return ops.select((F.col("at") + 1).alias("op_ord"), "o.*").select(*(c.split()[0] for c in PATCH.split(", ")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth items of a scored run."""
    return spark.read.schema("n int, citekey string, etype string, traits array<string>, truth map<string,string>").option("multiLine", "true").json(path)


def run_outputs(manifest: DataFrame, files: DataFrame, cfg: str) -> DataFrame:
    """(n, cfg, text, failed): the output file of every item of a run; files are (doc, text), named NN_citekey.bib in out_<cfg>."""
    name = F.concat(F.lit(f"out_{cfg}/"), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), F.col("citekey"), F.lit(".bib"))
    have = files.select(F.regexp_extract("doc", r"(out_[^/]+/[^/]+)$", 1).alias("name"), "text")
    j = manifest.withColumn("name", name).join(have, "name", "left")
    return j.select("n", F.lit(cfg).alias("cfg"), "text", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("failed"))


def pages_for_ocr(pages: Column) -> Column:
    """Page numbers that are worth reading again when a document has no text."""
    return key_pages(F.size(pages))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.bib"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition):
        from folioframe.operators.scan import scan

        if not partition.value:
            return
        with open(partition.value, "rb") as f:
            text = f.read().decode("utf-8", "replace")
        for r in scan(text):
            if r["kind"] == "entry":
                yield (partition.value, r["ord"], r["etype"], r["citekey"], {f["key"]: f["value"] for f in reversed(r["fields"])})


class LibraryDataSource(DataSource):
    """``spark.read.format("bib").load(folder)``: one row per entry, one task per file on a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "bib"

    def schema(self) -> str:
        return "path string, entry_ord int, etype string, citekey string, fields map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

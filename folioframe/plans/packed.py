"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.operators.packed import packed_fields, split_fields
from folioframe.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the author, editor and subject fields that hold at least two values."""
    return split_fields(packed_fields(table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "source_content")))


QUERIES = {"p2_found": p2_found}
ORACLE: dict[str, str] = {}

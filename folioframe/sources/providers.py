"""External answers (models, catalogues, pages, scans) as recorded tables.

A stage that needs an outside service takes a request table and a recording of (kind, key, answer).
Requests are answered by an equi-join on the request's hash; a missing recording is an error column,
never an invented answer. ``answer_with`` runs a callable per batch for live providers; its output
must be written before it is used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(requests: DataFrame) -> DataFrame:
    """Requests (id, kind, request) with the key that recordings are found by."""
    return requests.withColumn("key", F.sha2(F.concat_ws("\n", "kind", "request"), 256))


def recorded(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """(id, kind, answer, error) from recordings (key, answer)."""
    one = recordings.groupBy("key").agg(F.first("answer").alias("answer"))
    j = keyed(requests).join(one, "key", "left")
    return j.select("id", "kind", "answer", F.when(F.col("answer").isNull(), "no recording").alias("error"))


def answer_with(requests: DataFrame, ask: Callable[[str, str], str]) -> DataFrame:
    """(id, kind, answer, error) from a callable (kind, request) -> answer; its exceptions are errors of their row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, kind, request in zip(b["id"], b["kind"], b["request"]):
                try:
                    rows.append((i, kind, ask(kind, request), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "kind", "answer", "error"])

    return requests.select(F.col("id").cast("string"), "kind", "request").mapInPandas(run, "id string, kind string, answer string, error string")


def text_of_blocks(blocks):
    """Text of a typed block list: only text blocks count."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")

"""Structured Streaming: library files as they arrive, each content once, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.scan import field_rows, scan_documents
from folioframe.session import cut


def library_stream(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """(doc, text, arrived, hash) of files as they arrive; processed files may be moved to ``archive``."""
    r = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.bib")
    r = r.option("maxFileAge", "36500d")  # else the source drops files a week older than the newest
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    s = r.load(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))
    return s.withColumn("hash", F.sha2("text", 256))


def _stored_hashes(spark: SparkSession, path: str, prefixes: list[str], batch: str) -> DataFrame:
    """Hashes that other batches have written, of the given prefixes."""
    schema = "hash string, batch string, prefix string"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001 - the first batch has no hashes yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    return stored.filter(F.col("prefix").isin(prefixes) & (F.col("batch") != batch)).select("prefix", "hash")


def start_ingest(stream: DataFrame, out: str, checkpoint: str):
    """Write the fields of every new content, whatever its file's age; one run over what is there, restartable from its checkpoint.

    Each batch writes folders of its own in ``out`` and in the hashes beside the checkpoint, so a
    batch that is repeated after a failure replaces what it had written.
    """
    hashes = f"{checkpoint.rstrip('/')}-hashes"

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        batch = f"{spark.read.json(f'{checkpoint}/metadata').first().id}-{number}"
        once = rows.groupBy("hash").agg(F.min_by(F.struct("doc", "text"), "doc").alias("d")).select(F.substring("hash", 1, 2).alias("prefix"), "hash", "d.doc", "d.text")
        once = cut(once)
        prefixes = [r.prefix for r in once.select("prefix").distinct().collect()]  # at most 256
        new = cut(once.join(_stored_hashes(spark, hashes, prefixes, batch), ["prefix", "hash"], "left_anti"))
        field_rows(scan_documents(new.select("doc", "text"))).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        new.select("hash", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{hashes}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and type; works on a stream (late rows within ``late`` count) and on a table."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")

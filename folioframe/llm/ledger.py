"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The canonical key of a record is its title, author and date reduced to letters and digits in
order, each field apart. A *ledger* holds one row per key: the number of copies, and the earliest
representative. A new batch is aggregated first (map-side combine, so a key that holds a third of
the rows reaches the shuffle as one row per input task), then joined with the ledger by full outer
join on the key, counts are added and the earlier representative is kept. The ledger is written
in hash buckets, so an update reads and writes only the buckets that the batch touches.

Defined results: records without a title are kept out of the pairs, and counted where asked for; a null
field equals only a null; an empty or sign-only field is a value of its own, different from null;
ties of ``added_at`` go to the smaller id; an empty batch leaves the ledger as it is; further
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_FIELDS = ("title", "author", "entry_date")
#: Rows of a group are spread over tasks of about this many when pairs are formed.
PAIR_BLOCK = 256
#: Tasks over which the rows of one key are spread.
SALT = 16


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Combining marks, jamo, and the blocks of characters that composition replaces.
_COMPOSABLE = r"\p{M}|[\x{340}-\x{387}\x{958}-\x{95F}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2126}-\x{212B}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{F900}-\x{FB4F}\x{2F800}-\x{2FA1F}]"


def letters_digits(col: Column) -> Column:
    """Letters and digits of a value in their order, lower case; accents are part of the letter.

    Only values with characters that composition may change pass through Python; for all others a null crosses.
    """
    marked = col.rlike(_COMPOSABLE)
    composed = F.when(marked, _compose(F.when(marked, col))).otherwise(col)
    return F.lower(F.regexp_replace(composed, r"[^\p{L}\p{N}\p{M}]", ""))


def canonical_key(fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    """128-bit key over the fields; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), letters_digits(F.col(f))), F.lit("0")) for f in fields]
    text = F.concat_ws("\u0001", *parts)
    return F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), F.reverse(text))))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], "key string, copies bigint, first_at timestamp_ntz, entry_id bigint, bucket int")


def keyed(records: DataFrame, untitled: bool = False) -> DataFrame:
    """(entry_id, added_at, key) of the records that have a title, or of all records."""
    return (records if untitled else records.filter("title IS NOT NULL")).select("entry_id", "added_at", canonical_key().alias("key"))


def batch_counts(keys: DataFrame, buckets: int = 64) -> DataFrame:
    """One ledger row per key of a batch."""
    first = F.min(F.struct(F.coalesce("added_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("at"), F.col("entry_id").alias("id")))
    return (
        keys.groupBy("key")
        .agg(F.count("*").alias("copies"), first.alias("f"))
        .select("key", "copies", F.col("f.at").alias("first_at"), F.col("f.id").alias("entry_id"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
    )


def merge_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger after a batch of ``batch_counts`` rows: one full outer join on (bucket, key)."""
    a, b = ledger.alias("a"), batch.alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key"))
    earlier = F.least(F.struct(F.col("a.first_at").alias("at"), F.col("a.entry_id").alias("id")), F.struct(F.col("b.first_at").alias("at"), F.col("b.entry_id").alias("id")))
    kept = F.when(F.col("a.key").isNull(), F.struct(F.col("b.first_at").alias("at"), F.col("b.entry_id").alias("id"))).when(
        F.col("b.key").isNull(), F.struct(F.col("a.first_at").alias("at"), F.col("a.entry_id").alias("id"))
    ).otherwise(earlier)
    return a.join(b, on, "full_outer").select(
        F.coalesce("a.key", "b.key").alias("key"),
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
        kept["at"].alias("first_at"),
        kept["id"].alias("entry_id"),
        F.coalesce("a.bucket", "b.bucket").alias("bucket"),
    )


_MARK = "batch:"


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows, without the marks of its batches."""
    return spark.read.parquet(path).filter(~F.col("key").startswith(_MARK))


def update_ledger(spark, path: str, batch: DataFrame, batch_id: str | None = None) -> None:
    """Apply a batch to the ledger stored at ``path``, touching only the batch's buckets.

    With a ``batch_id`` every bucket keeps the mark of the batches it holds, in the same files as its
    counts: a batch that is delivered again, or repeated after a failure half-way, is added only to
    the buckets that do not hold it yet. Read such a ledger by ``read_ledger``.
    """
    from folioframe.session import cut

    batch = cut(batch)
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most the number of buckets
    try:
        old = spark.read.schema("key string, copies bigint, first_at timestamp_ntz, entry_id bigint, bucket int").parquet(path)
    except Exception as e:  # noqa: BLE001 - the first batch has no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = empty_ledger(spark)
    if batch_id is not None:
        done = {r.bucket for r in old.filter(F.col("key") == _MARK + batch_id).select("bucket").collect()}
        touched = [b for b in touched if b not in done]
        batch = batch.filter(F.col("bucket").isin(touched))
        if not touched:
            return
        marks = spark.createDataFrame([(_MARK + batch_id, 0, None, None, b) for b in touched], "key string, copies bigint, first_at timestamp_ntz, entry_id bigint, bucket int")
        batch = batch.unionByName(marks)
    new = cut(merge_ledger(old.filter(F.col("bucket").isin(touched)), batch))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def pairs_of_groups(members: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """All pairs (entry_a < entry_b) within each ``key`` of members (key, entry_id, copies).

    Members are spread over blocks by a hash of their id; block i meets block j >= i by an equi-join
    on (key, i, j), so that no task holds more than two blocks of a group, and no group is sorted
    or numbered as a whole.
    """
    blocks = F.ceil(F.col("copies") / block).cast("int")
    m = members.select("key", "entry_id", blocks.alias("bs"), F.pmod(F.xxhash64("entry_id"), blocks).cast("int").alias("blk"))
    left = m.select("key", F.col("entry_id").alias("a"), F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.col("bs") - 1)).alias("j"))
    right = m.select("key", F.col("entry_id").alias("b"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"))
    pairs = left.join(right, ["key", "i", "j"]).filter("i < j OR a < b")
    return pairs.select(F.least("a", "b").alias("entry_a"), F.greatest("a", "b").alias("entry_b"))


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records that differ in formatting only, through the ledger of their keys.

    The keys are computed once and written; the ledger's repeated keys meet the rows on
    (key, salt), so a key with a third of all rows is spread over ``SALT`` tasks.
    """
    from folioframe.session import cut

    keys = cut(keyed(records))
    ledger = merge_ledger(empty_ledger(records.sparkSession), batch_counts(keys))
    repeated = ledger.filter("copies > 1").select("key", "copies", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = keys.select("key", "entry_id", F.pmod(F.xxhash64("entry_id", F.lit(1)), F.lit(SALT)).cast("int").alias("salt"))
    return pairs_of_groups(rows.join(repeated, ["key", "salt"]))


def collapsed(records: DataFrame, untitled: bool = False) -> DataFrame:
    """One row per record, with its number of copies and its earliest representative; records without a title only if ``untitled``."""
    return merge_ledger(empty_ledger(records.sparkSession), batch_counts(keyed(records, untitled))).select("entry_id", "copies", "first_at")

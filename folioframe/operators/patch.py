"""Named patch operations: set, add, delete, retype, dropentry, noop.

Operations are joined to entries and fields by citekey and lower-case field; every operation gets a
status (``ok``, ``note``, ``problem``) and a message. Any problem blocks the whole list. The patched
library is the joined field table: sets by ``coalesce``, deletes by anti join, adds by union at the
alphabetical place among ordinary fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.schema import PROTECTED

OPERATIONS = ["set", "add", "delete", "retype", "dropentry", "noop"]
_PATCH_PROTECTED = PROTECTED[:-2] + "|keywords)$"


def checked(ops: DataFrame, entries: DataFrame, fields: DataFrame) -> DataFrame:
    """(op_ord, op, key, field, value, status, message) of ops (op_ord, op, key, field, value, why).

    ``entries`` has citekey, ``fields`` has citekey and key; a citekey counts once.
    """
    o = ops.withColumn("fkey", F.lower("field"))
    known = entries.select(F.col("citekey").alias("key")).distinct().withColumn("entry", F.lit(True))
    there = fields.select(F.col("citekey").alias("key"), F.col("key").alias("fkey")).distinct().withColumn("there", F.lit(True))
    j = o.join(known, "key", "left").join(there, ["key", "fkey"], "left")
    is_field = F.col("op").isin("set", "add", "delete")
    message = (
        F.when(~F.col("op").isin(*OPERATIONS), "unknown operation")
        .when(F.col("entry").isNull(), "no such entry")
        .when(is_field & F.col("fkey").isNull(), "no field named")
        .when(is_field & F.col("fkey").rlike(_PATCH_PROTECTED), "protected field")
        .when((F.col("op") == "set") & F.col("there").isNull(), "no such field")
        .when((F.col("op") == "add") & F.col("there").isNotNull(), "field exists")
        .when((F.col("op") == "delete") & F.col("there").isNull(), "already absent")
    )
    status = F.when(message == "already absent", "note").when(message.isNotNull(), "problem").otherwise("ok")
    return j.select("op_ord", "op", "key", "field", "value", "why", "fkey", status.alias("status"), message.alias("message"))


def blocked(check: DataFrame) -> bool:
    """Whether any operation is a problem, so that nothing may be written."""
    return not check.filter("status = 'problem'").isEmpty()


def applied(fields: DataFrame, check: DataFrame) -> DataFrame:
    """``patched`` for a list without problems; the fields unchanged if any operation is one."""
    return fields.select("citekey", "etype", "key", "name", "value") if blocked(check) else patched(fields, check)


def patched(fields: DataFrame, check: DataFrame) -> DataFrame:
    """(citekey, etype, key, name, value) after the operations with status ok; see ``applied`` for a list that may be written."""
    ok = check.filter("status = 'ok'")
    last = lambda op: ok.filter(F.col("op") == op).groupBy(F.col("key").alias("citekey"), F.col("fkey").alias("key")).agg(F.max_by("value", "op_ord").alias("new"))
    gone = ok.filter("op = 'delete'").select(F.col("key").alias("citekey"), F.col("fkey").alias("key")).distinct()
    dropped = ok.filter("op = 'dropentry'").select(F.col("key").alias("citekey")).distinct()
    types = ok.filter("op = 'retype'").groupBy(F.col("key").alias("citekey")).agg(F.max_by("value", "op_ord").alias("new_type"))
    kept = fields.join(dropped, "citekey", "left_anti").join(gone, ["citekey", "key"], "left_anti").join(last("set"), ["citekey", "key"], "left")
    kept = kept.select("citekey", "etype", "key", "name", F.coalesce("new", "value").alias("value"))
    heads = fields.join(dropped, "citekey", "left_anti").select("citekey", "etype").distinct()
    added = last("add").join(heads, "citekey").select("citekey", "etype", "key", F.col("key").alias("name"), F.col("new").alias("value"))
    return kept.unionByName(added).join(types, "citekey", "left").select("citekey", F.coalesce("new_type", "etype").alias("etype"), "key", "name", "value")


def anchor(ordinary: Column, key: Column) -> Column:
    """Last ordinary key before ``key``, stopping at the first that isn't; null to put it first."""
    stop = F.array_position(F.transform(ordinary, lambda k: k >= key), True)
    head = F.when(stop == 0, ordinary).otherwise(F.slice(ordinary, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    return F.get(head, F.size(head) - 1)

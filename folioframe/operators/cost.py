"""Cost of runs of a cached-prefix model: closed-form column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.schema import CACHE_READ, CACHE_WRITE, CHARS_PER_TOKEN, OUTPUT_TOKENS


def tokens(chars: Column) -> Column:
    return F.round(chars / CHARS_PER_TOKEN).cast("bigint")


def write_cost(static: Column, rate_in: Column, ttl: Column) -> Column:
    m = F.when(ttl == "5m", CACHE_WRITE["5m"]).otherwise(CACHE_WRITE["1h"])
    return static / 1e6 * rate_in * m


def read_cost(static: Column, rate_in: Column) -> Column:
    return static / 1e6 * rate_in * CACHE_READ


def call_cost(prefix: Column, dynamic: Column, kind: str, rate_in: Column, rate_out: Column) -> Column:
    return prefix + dynamic / 1e6 * rate_in + F.lit(OUTPUT_TOKENS[kind]) / 1e6 * rate_out


def run_total(n: Column, warm: Column, first: Column, later: Column, audit: Column) -> Column:
    """Cost of ``n`` files: the first call writes the prefix unless it is warm."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.when(warm, later).otherwise(first) + audit + (n - 1) * (later + audit))


def scenarios(base: dict[str, Column]) -> Column:
    """Array of (scenario, ttl, total) for one batch of ten, two of five, and ten single runs within an hour.

    ``base`` has first_5m, later_5m, first_1h, later_1h (extraction calls) and audit. A prefix that
    lives five minutes is cold at the start of every batch; one that lives an hour stays warm.
    """
    rows = []
    for name, batches, size in (("one batch of ten", 1, 10), ("two batches of five", 2, 5), ("ten single runs", 10, 1)):
        for ttl in ("5m", "1h"):
            first, later = base[f"first_{ttl}"], base[f"later_{ttl}"]
            cold = run_total(F.lit(size), F.lit(False), first, later, base["audit"])
            again = run_total(F.lit(size), F.lit(ttl == "1h"), first, later, base["audit"])
            rows.append(F.struct(F.lit(name).alias("scenario"), F.lit(ttl).alias("ttl"), (cold + (batches - 1) * again).alias("total")))
    return F.array(*rows)


def cheaper(total_5m: Column, total_1h: Column) -> Column:
    """Label of the cheaper lifetime; equal totals go to the shorter."""
    return F.when(total_5m <= total_1h, "5m").otherwise("1h")

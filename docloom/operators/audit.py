"""Append-only run logs: typed access, latest row per document, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_rows(rows: DataFrame, event: str, stamp: str, source: str | None = None, **fields) -> DataFrame:
    """Shape rows as log entries; extra fields go into a string map."""
    pairs = [x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))]
    return rows.select(
        F.lit(stamp).alias("timestamp"),
        F.lit(event).alias("event"),
        F.lit(source).cast("string").alias("source"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def latest_per_key(log: DataFrame, key: str, order: str, event: str | None = None) -> DataFrame:
    """The last row of each key; reduced map-side, so a hot key is no hot spot."""
    rows = log.filter(F.col("event") == event) if event else log
    fields = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(fields, order).alias("_r")).select(key, "_r.*")


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count("*").alias("rows"))

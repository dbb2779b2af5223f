"""Logs with open fields: each line one VARIANT value, read by path and type where a field is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that every line has.
KNOWN = ("timestamp", "event", "source")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as ``fields`` (VARIANT); ``broken`` holds a line that is no JSON, blank lines are skipped."""
    kept = lines.where(F.trim(column) != "").withColumn("fields", F.try_parse_json(F.col(column)))
    return kept.withColumn("broken", F.when(F.col("fields").isNull(), F.col(column))).drop(column)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, event, source, fields (the whole line), broken of JSON-lines logs (a file, folder or glob).

    No schema is fixed: nested values, lists and fields that only some events have keep
    their types.  A broken line is a row of its own and does not fail the read.
    """
    rows = parsed(spark.read.text(path))
    return rows.select(*(field(F.col("fields"), k).alias(k) for k in KNOWN), "fields", "broken")


def field(fields: Column, path: str, kind: str = "string") -> Column:
    """One field by path (``violations[0].kind``, or a whole JSON path from ``$``); null if absent or of another type."""
    return F.try_variant_get(fields, path if path.startswith("$") else f"$.{path}", kind)


def with_fields(log: DataFrame, **wanted: str) -> DataFrame:
    """Log rows with typed columns: ``with_fields(log, violations="array<string>", megabytes="double")``."""
    return log.withColumns({name: field(F.col("fields"), name, kind) for name, kind in wanted.items()})


def exploded(log: DataFrame, keep: list[str], fields: str = "fields") -> DataFrame:
    """One row per top-level field: the ``keep`` columns, key, value (VARIANT) and its type.

    A generator inside the scan's stage: nothing is shuffled.
    """
    source = log.select(*keep, F.col(fields).alias("_fields"))
    table = source.lateralJoin(source.sparkSession.tvf.variant_explode(F.col("_fields").outer()))
    return table.select(*keep, "key", "value", F.schema_of_variant("value").alias("type"))


def inventory(log: DataFrame, by: str = "event", fields: str = "fields") -> DataFrame:
    """Which fields the events carry: by, key, type, n (rows), and the least and greatest number.

    Counts are pre-aggregated in each task; groups are event kinds times keys, not values.
    """
    rows = exploded(log, [by], fields).where(F.col("key").isNotNull())
    number = F.try_variant_get(F.col("value"), "$", "double")
    return rows.groupBy(by, "key", "type").agg(F.count("*").alias("n"), F.min(number).alias("least"), F.max(number).alias("greatest"))


def merged_type(log: DataFrame, fields: str = "fields") -> DataFrame:
    """One row: the type that all lines' values fit."""
    return log.agg(F.schema_of_variant_agg(fields).alias("type"))

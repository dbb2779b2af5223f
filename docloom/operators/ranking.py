"""Global row numbers without passing the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# monotonically_increasing_id: the partition above this bit, the row inside it below.
_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n in ``order``, whose last column should be unique.

    One exchange: the rows are range partitioned and sorted by all of ``order``, so a value that
    many rows share is split by the columns behind it, and written with their place.  A table with
    one row a partition then holds how many rows stand before each; it is as small as the number of
    shuffle partitions, whatever the rows.  NULLs come first in ascending and last in descending
    order; rows equal in all of ``order`` get consecutive numbers.
    """
    placed = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_before") + inside + 1).cast("bigint").alias(name))
    )

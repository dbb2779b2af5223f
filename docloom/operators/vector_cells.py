"""A stored vector index: cells around centroids, exact nearest rows by the triangle inequality on angles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT, Settings
from docloom.functions import vectors
from docloom.session import materialize

# Rows that centroids are fitted on, centroids at most, rounds of fitting.
SAMPLE, MAX_CELLS, ROUNDS = 8_192, 4_096, 8
# Rows of a cell that one task multiplies, and queries it multiplies them with at a time.
PART_ROWS, STEP = 50_000, 64
# Angles are compared with this much room for rounding.
SLACK = 1e-7


@dataclass(frozen=True)
class CellIndex:
    """rows (cell, part, key, v, angle to the cell's centroid), cells (cell, centroid, n, low, high of the angles)."""

    rows: DataFrame
    cells: DataFrame
    key: str

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "chunk_id") -> "CellIndex":
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), key)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fit(table: DataFrame, cells: int, column: str = "v", seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means on at most SAMPLE rows, those of the smallest hash, in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x for b in batches for x in b.column("v").to_pylist()]
        points = np.unique(np.array(own, np.float64), axis=0) if own else np.zeros((0, 0))
        centers = points[np.random.default_rng(seed).permutation(len(points))[:cells]]
        for _ in range(ROUNDS if len(points) else 0):
            nearest = np.argmax(points @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, points)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centers)
        yield pa.RecordBatch.from_arrays([pa.array(centers.tolist(), pa.list_(pa.float64()))], names=["center"])

    sample = table.select(F.col(column).alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE)
    found = sample.repartition(1).mapInArrow(run, "center array<double>").collect()
    return np.array([r["center"] for r in found], np.float64)


def _usable(table: DataFrame, key: str, column: str) -> DataFrame:
    """key and unit vector v; rows without a direction (null, empty, zero, not finite) are left out."""
    unit = table.select(F.col(key), vectors.as_double(F.col(column)).alias("raw")).where(
        F.exists("raw", lambda x: x != 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return unit.select(key, vectors.l2_normalize(F.col("raw")).alias("v"))


def _assigned(unit: DataFrame, centers: np.ndarray, key: str) -> DataFrame:
    shared = unit.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), unit.schema[key], unit.schema["v"], T.StructField("angle", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _angles(_matrix(batch.column("v")), shared.value)
                cell = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(key), batch.column("v"), pa.array(apart[np.arange(len(cell)), cell])], names=["cell", key, "v", "angle"])

    return unit.mapInArrow(run, schema)


def _summary(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    known = rows.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, centroid array<double>")
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).join(F.broadcast(known), "cell")


def _dealt(table: DataFrame, cells: int, key: str, column: str) -> tuple[DataFrame, np.ndarray]:
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be between 1 and {MAX_CELLS}")
    unit = _usable(table, key, column)
    centers = fit(unit, cells)
    if not len(centers):
        return unit.select(F.lit(0).alias("cell"), key, "v", F.lit(0.0).alias("angle")).limit(0), centers
    return _assigned(unit, centers, key), centers


def build(table: DataFrame, cells: int = 256, *, key: str = "chunk_id", column: str = "embedding") -> CellIndex:
    """An index of every row in the session's work folder; see ``write``."""
    rows, centers = _dealt(table, cells, key, column)
    rows = materialize(rows)
    return CellIndex(rows, materialize(_summary(rows, centers)), key)


def write(table: DataFrame, path: str, cells: int = 256, *, key: str = "chunk_id", column: str = "embedding") -> CellIndex:
    """Store the index of every row with a direction, one folder per cell, and open it.

    Centroids come from a bounded sample (SAMPLE rows); they decide what is skipped, not
    what is found.  A cell's rows are dealt to several files by key, so a cell that holds
    most rows is not one task's work.
    """
    spark = table.sparkSession
    rows, centers = _dealt(table, cells, key, column)
    files = F.pmod(F.xxhash64(key), F.lit(8))
    rows.repartition("cell", files).sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    _summary(stored, centers).write.mode("overwrite").parquet(f"{path}/cells")
    return CellIndex(stored, spark.read.parquet(f"{path}/cells"), key)


def _bounds(index: CellIndex, queries: DataFrame, qid: str, column: str) -> DataFrame:
    """q, which, v, cell, n, apart (angle to the centroid), lower (no row of the cell is nearer), for every cell.

    Cells are MAX_CELLS at most, so their centroids reach every task.
    """
    cells = index.cells.orderBy("cell").collect()
    shared = queries.sparkSession.sparkContext.broadcast(tuple(
        np.array([r[c] for r in cells], d) for c, d in (("cell", np.int32), ("n", np.int64), ("low", float), ("high", float), ("centroid", float))))
    asked = _usable(queries, qid, column).select(F.col(qid).alias("q"), "v", F.xxhash64(F.col(qid).isNull(), qid, "v").alias("which")).distinct()
    schema = T.StructType([asked.schema["q"], T.StructField("which", T.LongType()), asked.schema["v"], T.StructField("cell", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("apart", T.DoubleType()), T.StructField("lower", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, n, low, high, centers = shared.value
        if not len(cell):
            return
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                apart = _angles(_matrix(part.column("v")), centers)
                lower = np.maximum(0.0, np.maximum(apart - high, low - apart))
                row = pa.array(np.repeat(np.arange(part.num_rows), len(cell)))
                yield pa.RecordBatch.from_arrays([
                    part.column("q").take(row), part.column("which").take(row), part.column("v").take(row), pa.array(np.tile(cell, part.num_rows)),
                    pa.array(np.tile(n, part.num_rows)), pa.array(apart.ravel()), pa.array(lower.ravel())], names=schema.names)

    return asked.mapInArrow(run, schema)


def _nearest_in(index: CellIndex, pairs: DataFrame, k: int) -> DataFrame:
    """q, which, key and distance of the ``k`` nearest rows of each (query, cell part) within the query's ``limit``."""
    key = index.key
    wanted = pairs.select("cell", "n").distinct()  # at most MAX_CELLS rows
    part = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("n") / PART_ROWS)))
    rows = index.rows.join(F.broadcast(wanted), "cell").select("cell", part.alias("part"), F.col(key).alias("k"), "v", "angle")
    tries = pairs.select("q", "which", "v", "cell", "apart", "limit", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PART_ROWS) - 1)).alias("part"))
    schema = T.StructType([pairs.schema["q"], T.StructField("which", T.LongType()), T.StructField("k", index.rows.schema[key].dataType), T.StructField("distance", T.DoubleType())])

    def cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        picked, owner, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if mine.num_rows and theirs.num_rows:
            mine = mine.sort_by("angle")
            v, angle = _matrix(mine.column("v")), mine.column("angle").to_numpy()
            order = np.empty(len(v), np.int64)
            order[pc.sort_indices(mine.column("k")).to_numpy()] = np.arange(len(v))
            asked, apart, limit = _matrix(theirs.column("v")), theirs.column("apart").to_numpy(), theirs.column("limit").to_numpy()
            for j in range(len(asked)):
                # Rows whose angle to the centroid alone does not rule them out.
                a, b = np.searchsorted(angle, [apart[j] - limit[j] - SLACK, apart[j] + limit[j] + SLACK])
                near = np.round(1.0 - v[a:b] @ asked[j], 9)
                best = np.lexsort((order[a:b], near))[:k]
                picked.append(best + a)
                owner.append(np.full(len(best), j))
                distance.append(near[best])
        who = pa.array(np.concatenate(owner))
        return pa.table([theirs.column("q").take(who), theirs.column("which").take(who), mine.column("k").take(pa.array(np.concatenate(picked))), pa.array(np.concatenate(distance))],
                        schema=pa.schema([("q", theirs.schema.field("q").type), ("which", pa.int64()), ("k", mine.schema.field("k").type), ("distance", pa.float64())]))

    return rows.groupBy("cell", "part").cogroup(tries.groupBy("cell", "part")).applyInArrow(cell, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "which").orderBy("distance", "k")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chosen(index: CellIndex, queries: DataFrame, k: int, qid: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of a query and a cell read first, what they gave, and the pairs that can still matter."""
    bounds = materialize(_bounds(index, queries, qid, column))
    nearest = Window.partitionBy("q", "which").orderBy("lower", "apart", "cell")
    marked = bounds.withColumn("before", F.sum("n").over(nearest) - F.col("n"))
    first = materialize(marked.where(F.col("before") < k).withColumn("limit", F.lit(np.pi)).drop("before"))
    given = materialize(_ranked(_nearest_in(index, first, k), k))
    reach = given.where(F.col("rank") == k).select("which", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))).alias("reach"))
    # ``which`` tells queries apart, also those without an id.
    rest = bounds.join(first.select("which", "cell"), ["which", "cell"], "left_anti").join(reach, "which", "left")
    # Distances are rounded to nine digits; near zero that is an angle of some 1e-4.
    limit = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.cos("reach") - 2e-9)), F.lit(np.pi))
    rest = materialize(rest.withColumn("limit", limit).where(F.col("lower") <= F.col("limit") + SLACK).select(*first.columns))
    return first, given, rest


def nearest_many(index: CellIndex, queries: DataFrame, k: int | None = None, *, qid: str = "qid", column: str = "embedding", cfg: Settings = DEFAULT) -> DataFrame:
    """Top ``k`` rows for each query vector: qid, key, distance, rank; the rows of ``vector.nearest_many``.

    A query first reads the cells it may lie in until they hold k rows; the k-th distance
    found is its reach.  By the triangle inequality on angles no row of a cell is nearer
    than its lower bound, so only cells (and inside them, rows) within the reach are read
    after that: nothing that could be among the k is skipped.  Rows and queries without a
    direction have no place in the index and no rows.
    """
    k = k or cfg.top_k
    first, given, rest = _chosen(index, queries, k, qid, column)
    more = _nearest_in(index, rest, k)
    return _ranked(given.drop("rank").unionByName(more), k).select(F.col("q").alias(qid), F.col("k").alias(index.key), "distance", "rank")


def reading(index: CellIndex, queries: DataFrame, k: int, qid: str = "qid", column: str = "embedding") -> DataFrame:
    """One row per query: cells and rows of the whole table, and those that were read for it."""
    first, _, rest = _chosen(index, queries, k, qid, column)
    read = first.select("q", "which", "n").unionByName(rest.select("q", "which", "n")).groupBy("q", "which").agg(
        F.count("*").alias("cells_read"), F.sum("n").alias("rows_read"))
    whole = index.cells.agg(F.struct(F.count("*").alias("cells"), F.sum("n").alias("rows")).alias("w")).scalar()
    return read.withColumn("w", whole).select(F.col("q").alias(qid), "cells_read", "rows_read", "w.cells", "w.rows")

"""Helpers that several operators share: text batches, hold-out folds, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one vectorised step inside a task works on.
SLICE_BYTES = 8 << 20


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wrapped(docs: DataFrame, text_col: str) -> DataFrame:
    """Whole rows as one column ``row`` beside ``text``, so that no column of theirs can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that ``spark.checkpoint.dir`` names.

    Without it a local folder serves in local mode; on a cluster executors would not share it,
    which raises ValueError.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; lost executors cost nothing then."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files behind a table of ``written``, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; one row may exceed it."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The text column with null as the empty string."""
    return pc.fill_null(batch.column(text), "")


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts in order, very long ones cut after spaces: groups of (number of the text, piece).

    A group has about ``limit`` characters, so what is derived from it stays bounded; a run
    of more than ``limit`` characters without a space is cut where it is.
    """
    owner, held, total = [], [], 0
    for k, text in enumerate(texts.to_pylist()):
        start = 0
        while True:
            end = len(text) if len(text) - start <= limit else (text.rfind(" ", start, start + limit) + 1 or start + limit)
            owner.append(k)
            held.append(text[start:end])
            total += end - start
            if total >= limit:
                yield np.array(owner), pa.array(held, pa.string())
                owner, held, total = [], [], 0
            start = end
            if start >= len(text):
                break
    if held:
        yield np.array(owner), pa.array(held, pa.string())


def code_points(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each followed by ``pad`` spaces, and the start of each text."""
    parts = [t.lower() for t in texts.to_pylist()]
    gap = " " * pad
    codes = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(p) + pad for p in parts), np.int64, len(parts))
    return codes, np.cumsum(lengths) - lengths


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int,
                    max_text_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Columns text and label of at most ``max_rows`` labelled texts whose ids are ``usable``.

    The rows are those with the smallest hash of their id, so the choice does not depend on
    the layout of the table.  Texts beyond ``max_text_bytes`` are not learned from.  The
    chosen labels are broadcast, which ``max_rows`` bounds; documents are not shuffled.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(id_col).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    )
    return (
        docs.select(id_col, F.col(text_col).alias("_text")).where(F.octet_length("_text") <= max_text_bytes)
        .join(F.broadcast(chosen), id_col)
        .orderBy(F.xxhash64(id_col), id_col, "_text").limit(max_rows)
        .select(F.col("_text").alias("text"), F.col("_label").cast("int").alias("label"))
    )

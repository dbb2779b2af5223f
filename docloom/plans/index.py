"""Chunk table to vector table: cascade, change detection, embedding, upsert, statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT, Settings
from docloom.functions import fixed_values as fv
from docloom.functions.vectors import _digest_vector
from docloom.operators import checks, merge
from docloom.session import materialize


@dataclass(frozen=True)
class IndexRun:
    vectors: DataFrame
    errors: DataFrame
    deleted: DataFrame
    stats: DataFrame


def digest_batch(dimension: int):
    """The offline encoder in batch form: texts to vectors."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [_digest_vector(t, dimension) for t in texts]

    return encode


def embed(chunks: DataFrame, encode, cfg: Settings = DEFAULT) -> DataFrame:
    """Chunks with a unit ``embedding`` or the ``error`` of their request batch.

    Each task cuts its rows into requests by count and characters; a failing request
    marks its own rows and the run goes on.
    """
    size, budget, prefix = cfg.embed_batch_size, cfg.embed_max_chars, fv.PASSAGE_PREFIX
    schema = T.StructType(
        chunks.schema.fields
        + [
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def request(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.strip() for t in rows["exact_context"]]
        texts = [t if t.startswith(prefix) else prefix + t for t in texts]
        out = rows.copy()
        try:
            matrix = np.asarray(encode(texts), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            if (norms == 0).any():
                raise ValueError("cannot normalise a zero vector")
            out["embedding"], out["error"] = list(matrix / norms), None
        except Exception as exc:  # isolated to this request
            out["embedding"], out["error"] = None, str(exc)
        return out

    def run(batches):
        for pdf in batches:
            lengths = pdf["exact_context"].str.len().to_numpy()
            start = chars = 0
            for i, n in enumerate(lengths):
                if i > start and (i - start >= size or chars + n > budget):
                    yield request(pdf.iloc[start:i])
                    start, chars = i, 0
                chars += n
            if start < len(pdf):
                yield request(pdf.iloc[start:])

    return chunks.mapInPandas(run, schema)


def run(
    chunks: DataFrame, stored: DataFrame, tombstones: DataFrame, *, encode=None,
    prune_only: bool = False, cfg: Settings = DEFAULT,
) -> IndexRun:
    """Bring the vector table in step with the chunk table."""
    encode = encode or digest_batch(cfg.embedding_dimension)
    deleted = merge.count_deletions(stored, tombstones)
    remaining = merge.delete_documents(stored, tombstones)
    changes = merge.classify_changes(chunks, remaining)
    if prune_only:
        return IndexRun(
            remaining, chunks.limit(0).withColumn("error", F.lit("")), deleted,
            checks.index_stats(remaining, changes.limit(0), cfg=cfg),
        )
    # Embedding is the expensive step and feeds both results, so it is written once.
    made = materialize(
        embed(changes.filter(F.col("change") != "unchanged").drop("change"), encode, cfg)
    )
    columns = stored.columns
    good = made.filter(F.col("error").isNull()).select(*columns)
    errors = made.filter(F.col("error").isNotNull()).select("chunk_id", "error")
    vectors = merge.upsert(remaining, good)
    return IndexRun(vectors, errors, deleted, checks.index_stats(vectors, changes, cfg=cfg))

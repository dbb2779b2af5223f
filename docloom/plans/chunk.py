"""Catalog and page texts to the merged chunk table, its index and checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.operators import audit, chunking
from docloom.session import materialize


@dataclass(frozen=True)
class ChunkRun:
    pending: DataFrame
    chunks: DataFrame
    checkpoints: DataFrame
    counters: DataFrame
    log: DataFrame


def run(
    catalog: DataFrame, pages: DataFrame, stored: DataFrame, checkpoints: DataFrame,
    tombstones: DataFrame, *, created_at: str, force: bool = False, cfg: Settings = DEFAULT,
) -> ChunkRun:
    """Chunk documents that are new or ingested again; drop those that were pruned.

    ``pages``: document_id, pages, error.  A document whose chunks are all dropped loses
    its earlier chunks too.
    """
    live = catalog.join(tombstones.select("document_id").distinct(), "document_id", "left_anti")
    pending = live if force else chunking.pending_documents(live, checkpoints)
    texts = pending.join(pages.select("document_id", "pages", "error"), "document_id", "left")
    outcome = (
        F.when(F.col("pages").isNull(), "skipped_missing")
        .when(F.col("error").isNotNull(), "skipped_extract")
        .otherwise("processed")
    )
    judged = texts.withColumn("outcome", outcome)
    ready = judged.filter(F.col("outcome") == "processed").drop("error", "outcome")
    # Written once: the chunk table, the checkpoints and the review all read it.
    made = materialize(chunking.chunk_records(ready, created_at, cfg))
    clean = chunking.drop_pii_chunks(made)
    replaced = judged.filter(F.col("outcome") == "processed").select("document_id")
    gone = replaced.unionByName(tombstones.select("document_id")).distinct()
    merged = stored.join(gone, "document_id", "left_anti").unionByName(clean)
    renewed = chunking.checkpoints(clean, catalog, cfg)
    kept = checkpoints.join(gone, "document_id", "left_anti")
    skipped = audit.log_rows(
        judged.filter(F.col("outcome") != "processed"), "document_skipped", created_at,
        document_id=F.col("document_id"), reason=F.col("outcome"),
    )
    dirty = chunking.pii_report(made, cfg)
    review = audit.log_rows(
        dirty.filter("review"), "document_pii_review", created_at,
        document_id=F.col("document_id"), dropped=F.col("dropped"), total=F.col("total"),
    )
    counters = judged.groupBy("outcome").agg(F.count("*").alias("documents"))
    return ChunkRun(pending, merged, kept.unionByName(renewed), counters, skipped.unionByName(review))

"""Discovered items to catalog rows, tombstones, counters and log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.operators import audit, catalog as cat


@dataclass(frozen=True)
class IngestRun:
    catalog: DataFrame
    tombstones: DataFrame
    admitted: DataFrame
    counters: DataFrame
    log: DataFrame


def run(
    discovered: DataFrame, catalog: DataFrame, tombstones: DataFrame, *, ingested_at: str,
    max_per_source: int | None = None, max_documents: int | None = None, cfg: Settings = DEFAULT,
) -> IngestRun:
    """Admit new clean documents, merge them, keep the newest if a number is given, remember what was pruned."""
    admitted = cat.admit(discovered, catalog, ingested_at, max_per_source=max_per_source)
    new = admitted.filter(F.col("outcome") == "ingested").select(
        *[c for c in catalog.columns if c != "chronological_rank"]
    )
    merged = catalog.drop("chronological_rank").unionByName(new)
    kept, pruned = cat.retain_newest(merged, max_documents)
    log = (
        audit.log_rows(
            admitted.filter(F.col("outcome") == "ingested"), "document_ingested", ingested_at,
            document_id=F.col("document_id"), source_url=F.col("source_url"),
            local_path=F.col("local_path"),
        )
        .unionByName(
            audit.log_rows(
                admitted.filter(F.col("outcome") == "skipped_pii"), "pii_rejected", ingested_at,
                document_id=F.col("document_id"),
            )
        )
        .unionByName(
            audit.log_rows(pruned, "document_pruned", ingested_at, document_id=F.col("document_id"))
        )
    )
    return IngestRun(
        kept, tombstones.unionAll(pruned), admitted, cat.admission_counts(admitted), log
    )

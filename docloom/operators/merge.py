"""Keeping derived tables in step: change detection, upsert, cascade, orphans, patches.

Tables are merged DataFrame-in, DataFrame-out; a sink then overwrites the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from docloom.functions import identity, quality, urls


def classify_changes(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks with ``change``: new, changed or unchanged against the stored hashes.

    A changed chunk loses its verification.
    """
    known = stored.select("chunk_id", F.col("content_hash").alias("_hash"))
    return (
        chunks.join(known, "chunk_id", "left")
        .withColumn(
            "change",
            F.when(F.col("_hash").isNull(), "new")
            .when(F.col("_hash") == F.col("content_hash"), "unchanged")
            .otherwise("changed"),
        )
        .withColumn(
            "verification_status",
            F.when(F.col("change") == "changed", "unverified").otherwise(
                F.col("verification_status")
            ),
        )
        .drop("_hash")
    )


def to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    return classify_changes(chunks, stored).filter(F.col("change") != "unchanged").drop("change")


def first_of_each_key(rows: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Of rows with one key the first by ``order``; rows without a key are all kept.

    Without an order the row with the smallest hash of its columns stays, so that the choice
    does not depend on how the rows arrive.
    """
    by = order or [F.xxhash64(*(c for c in rows.columns if c != key)) if len(rows.columns) > 1 else F.col(key)]
    # Rows without a key have nothing to be ranked among and stay out of the shuffle by key.
    keyed, loose = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_nth = 1").drop("_nth")
    return first.unionByName(loose)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: list[Column] | None = None) -> DataFrame:
    """Incoming rows replace stored rows with the same key.

    Of repeated incoming keys the first by ``order`` stays (see ``first_of_each_key``); rows
    whose key is NULL replace nothing and are all added.
    """
    incoming = first_of_each_key(incoming, key, order)
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_keys(stored: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def delete_documents(stored: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop every row whose chunk id belongs to a tombstoned document.

    The id's document part makes the prefix match an equality, so it is a plain anti-join.
    """
    keyed = stored.withColumn("_document", identity.document_of_chunk(F.col("chunk_id")))
    gone = tombstones.select(F.col("document_id").alias("_document")).distinct()
    return keyed.join(gone, "_document", "left_anti").drop("_document")


def clear_tombstones(tombstones: DataFrame, stored: DataFrame) -> DataFrame:
    """Tombstones that still have work to do: their document has rows in ``stored``.

    After a complete cascade none is left; one that a failed cascade did not reach stays.
    """
    left = stored.select(identity.document_of_chunk(F.col("chunk_id")).alias("document_id")).distinct()
    return tombstones.join(left, "document_id", "left_semi")


def count_deletions(stored: DataFrame, tombstones: DataFrame) -> DataFrame:
    """How many rows a cascade would delete; the dry run."""
    gone = tombstones.select(F.col("document_id").alias("_document")).distinct()
    return (
        stored.withColumn("_document", identity.document_of_chunk(F.col("chunk_id")))
        .join(gone, "_document", "left_semi")
        .agg(F.count("*").alias("chunks_deleted"))
    )


def drop_orphans(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks whose document is still in the catalog."""
    return chunks.join(catalog.select("document_id"), "document_id", "left_semi")


def orphans(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    return chunks.join(catalog.select("document_id"), "document_id", "left_anti")


def portfolio_only(catalog: DataFrame) -> DataFrame:
    return catalog.filter(
        quality.is_portfolio_document(
            F.col("source_org"), F.col("source_url"), F.col("local_path")
        )
    )


def patch_links(rows: DataFrame) -> DataFrame:
    """Repair retired article links and the titles that go with them; flag what changed."""
    old = F.col("source_url")
    repaired = urls.resolve_source_url(old)
    return rows.withColumns(
        {
            "document_title": urls.patched_title(old, F.col("document_title")),
            "source_url": F.when(repaired != old, repaired).otherwise(old),
            "patched": repaired != F.trim(old),
        }
    )


def set_verified(chunks: DataFrame, verified: DataFrame) -> DataFrame:
    """Mark chunks that a reviewer verified."""
    marks = verified.select("chunk_id").distinct().withColumn("_v", F.lit(True))
    return (
        chunks.join(marks, "chunk_id", "left")
        .withColumn(
            "verification_status",
            F.when(F.col("_v"), "verified").otherwise(F.col("verification_status")),
        )
        .drop("_v")
    )


def metadata_view(chunks: DataFrame) -> DataFrame:
    """The scalar columns stored beside a vector."""
    return chunks.select(
        "source_url", "document_title", "publication_year", "page_number", "exact_context",
        "verification_status", "source_org", "chunk_id", "content_hash",
    )


def require_scalars(metadata: DataFrame) -> DataFrame:
    """``metadata`` if every column is a string, number or boolean; TypeError names the others."""
    wrong = [f.name for f in metadata.schema if not isinstance(f.dataType, (StringType, NumericType, BooleanType))]
    if wrong:
        raise TypeError(f"metadata fields that are not scalars: {', '.join(wrong)}")
    return metadata


def missing_metadata(metadata: DataFrame) -> DataFrame:
    """field, missing: how many rows lack a value of each scalar field; a store takes no NULLs."""
    counted = require_scalars(metadata).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in metadata.columns))
    return counted.unpivot([], metadata.columns, "field", "missing")


def upsert_payload(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids, vectors, texts and metadata of one write, matched by chunk id."""
    meta = require_scalars(metadata_view(chunks))
    return meta.join(vectors.select("chunk_id", "embedding"), "chunk_id").select(
        F.col("chunk_id").alias("id"),
        "embedding",
        F.col("exact_context").alias("document"),
        F.struct(*meta.columns).alias("metadata"),
    )


def chunk_text(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """Displayable text of one chunk; NULL for placeholders."""
    from docloom.functions.text import sanitize, strip

    raw = strip(F.col("exact_context"))
    return chunks.filter(F.col("chunk_id") == chunk_id).select(
        "chunk_id",
        F.when((raw != "") & ~quality.is_placeholder(raw), F.coalesce(
            F.nullif(sanitize(raw), F.lit("")), raw
        )).alias("text"),
    )


def chunk_detail(chunks: DataFrame, stored_text: DataFrame) -> DataFrame:
    """Reviewable chunks: placeholder text repaired, cleaned, links and titles resolved."""
    from docloom.functions.text import sanitize

    canonical = stored_text.select("chunk_id", F.col("exact_context").alias("_canonical"))
    text = F.when(
        quality.is_placeholder(F.col("exact_context"))
        & ~quality.is_placeholder(F.col("_canonical")),
        F.coalesce(F.col("_canonical"), F.col("exact_context")),
    ).otherwise(F.col("exact_context"))
    url = urls.resolve_source_url(F.col("source_url"))
    return (
        chunks.join(canonical, "chunk_id", "left")
        .withColumn("exact_context", sanitize(text))
        .filter(F.trim("exact_context") != "")
        .select(
            "chunk_id",
            url.alias("source_url"),
            quality.resolve_title(F.col("document_title"), url, F.col("exact_context")).alias(
                "document_title"
            ),
            "publication_year",
            "page_number",
            "exact_context",
            F.lit("unverified").alias("verification_status"),
            "source_org",
            "content_hash",
        )
    )

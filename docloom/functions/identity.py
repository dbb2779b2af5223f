"""Stable identifiers and digests; bit-exact, so they must never change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip


def document_id(url: Column, title: Column) -> Column:
    canonical = F.concat(F.lower(strip(url)), F.lit("|"), F.lower(strip(title)))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(canonical, 256), 1, 16))


def chunk_id(document: Column, page_number: Column, chunk_index: Column) -> Column:
    return F.format_string("%s::p%04d::c%04d", document, page_number, chunk_index)


def document_of_chunk(chunk: Column) -> Column:
    return F.split_part(chunk, F.lit("::"), F.lit(1))


def document_key(chunk: Column, title: Column) -> Column:
    """The document part of a chunk id, or the title when the id has no such part."""
    return F.when(F.contains(chunk, F.lit("::")), document_of_chunk(chunk)).otherwise(title)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def combined_hash(hashes: Column) -> Column:
    """Order-free digest of a document's chunk hashes."""
    return F.when(F.size(hashes) == 0, F.lit("sha256:empty")).otherwise(
        F.concat(
            F.lit("sha256:"),
            F.substring(F.sha2(F.array_join(F.array_sort(hashes), "\n"), 256), 1, 16),
        )
    )


def safe_name(document: Column) -> Column:
    return F.translate(document, ":", "_")


def local_path(source_org: Column, document: Column, content_type: Column) -> Column:
    return F.concat(
        F.lower(source_org),
        F.lit("/"),
        safe_name(document),
        F.when(content_type == "pdf", F.lit(".pdf")).otherwise(F.lit(".html")),
    )


def hash_bucket(key: Column, buckets: int) -> Column:
    """First eight hex digits of sha256 modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets

"""Documents to sections, units, bounded overlapping chunks and hashed chunk records.

Input shape: ``document_id`` plus ``pages``, an ordered array of
``struct<page_number:int,text:string>``.  Everything up to the chunk records is a narrow
transformation of one row; only the per-document index aggregates across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.functions import identity, quality, structure
from docloom.functions.dates import publication_year
from docloom.functions.text import sanitize
from docloom.session import explode_rows, let


def single_page(df: DataFrame, text: str = "text") -> DataFrame:
    """Treat a plain text column as a one-page document."""
    page = F.struct(F.lit(1).alias("page_number"), F.col(text).alias("text"))
    return df.withColumn("pages", F.array(page))


def with_sections(docs: DataFrame, *, merge: bool = True, cfg: Settings = DEFAULT) -> DataFrame:
    """Add ``sections``: array of (page_number, title, text, start_char, end_char)."""

    def of_page(page):
        found = structure.page_sections(page["text"])
        if merge:
            found = structure.merge_short_sections(found, cfg.min_section_chars)
        return F.transform(
            found,
            lambda s: F.struct(
                page["page_number"].alias("page_number"),
                s["title"].alias("title"),
                s["text"].alias("text"),
                s["start_char"].alias("start_char"),
                s["end_char"].alias("end_char"),
            ),
        )

    return docs.withColumn("sections", F.flatten(F.transform("pages", of_page)))


def with_units(docs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Add ``units``: sentence groups that never cross a section border."""

    def of_section(section):
        return F.transform(
            structure.pack_sentences(section["text"], cfg.soft_max_tokens),
            lambda u: F.struct(
                section["page_number"].alias("page_number"),
                section["title"].alias("section_title"),
                u["text"].alias("text"),
                u["token_count"].alias("token_count"),
                u["sentence_count"].alias("sentence_count"),
            ),
        )

    return docs.withColumn("units", F.flatten(F.transform("sections", of_section)))


def with_drafts(docs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Add ``drafts``: capped pieces, each after the first prefixed with an overlap.

    A piece that follows another leaves room for the overlap, so no text is dropped
    to stay under the cap.
    """
    room = cfg.max_tokens - cfg.overlap_tokens

    def pieces_of(unit, i):
        texts = F.when(
            i == 0, structure.cap_text(unit["text"], room, cfg.max_tokens, unit["token_count"])
        ).otherwise(structure.cap_text(unit["text"], room, count=unit["token_count"]))
        return F.transform(
            texts,
            lambda t: F.struct(
                unit["page_number"].alias("page_number"),
                unit["section_title"].alias("section_title"),
                t.alias("text"),
            ),
        )

    def number(pieces):
        return let(
            structure.with_overlap(pieces, cfg.overlap_tokens),
            lambda over: F.transform(
                pieces,
                lambda p, i: F.struct(
                    i.alias("seq"),
                    p["page_number"].alias("page_number"),
                    p["section_title"].alias("section_title"),
                    F.get(over, i)["text"].alias("exact_context"),
                    F.get(over, i)["token_count"].alias("token_count"),
                ),
            ),
        )

    pieces = F.flatten(F.transform("units", pieces_of))
    return docs.withColumn("drafts", let(pieces, number))


def _numbered(drafts: Column) -> Column:
    """Drafts with their 1-based number on the page, before any filter."""
    return let(
        drafts,
        lambda ds: let(
            F.transform(ds, lambda d: d["page_number"]),
            lambda pages: F.transform(
                ds,
                lambda d, i: F.struct(
                    d["seq"].alias("seq"),
                    d["page_number"].alias("page_number"),
                    # Pages come in order: the number is the distance to the page's start.
                    (i - F.array_position(pages, d["page_number"]) + 2).cast("int").alias(
                        "chunk_index"
                    ),
                    d["section_title"].alias("section_title"),
                    d["exact_context"].alias("exact_context"),
                    d["token_count"].alias("token_count"),
                ),
            ),
        ),
    )


def _kept_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("pages", "sections", "units", "drafts")]


def explode_drafts(docs: DataFrame) -> DataFrame:
    """One row per draft."""
    return explode_rows(docs, _numbered(F.col("drafts")), _kept_columns(docs))


def chunk_records(docs: DataFrame, created_at: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Catalog rows with ``pages`` to the chunk fact table (14 columns).

    The page number is part of the id before filtering, so dropped noise leaves gaps and
    ids stay stable; ``token_count`` describes the draft, ``char_count`` the kept text.
    """
    drafted = with_drafts(with_units(with_sections(docs, cfg=cfg), cfg), cfg)

    def worth_keeping(d: Column) -> Column:
        text = d["exact_context"]
        return (text != "") & ~quality.is_placeholder(text) & ~quality.is_explicit_noise(text)

    cleaned = F.transform(
        _numbered(F.col("drafts")),
        lambda d: F.struct(
            d["page_number"].alias("page_number"),
            d["chunk_index"].alias("chunk_index"),
            sanitize(d["exact_context"]).alias("exact_context"),
            d["token_count"].alias("token_count"),
        ),
    )
    kept = explode_rows(drafted, F.filter(cleaned, worth_keeping), _kept_columns(docs))
    return kept.select(
        identity.chunk_id(F.col("document_id"), F.col("page_number"), F.col("chunk_index")).alias(
            "chunk_id"
        ),
        "document_id",
        "source_org",
        "source_url",
        "document_title",
        publication_year(F.col("publication_date")).alias("publication_year"),
        "page_number",
        "chunk_index",
        "exact_context",
        "token_count",
        F.length("exact_context").alias("char_count"),
        F.lit("unverified").alias("verification_status"),
        identity.content_hash(F.col("exact_context")).alias("content_hash"),
        F.lit(created_at).alias("created_at"),
    )


def drop_pii_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(quality.is_clean(F.col("exact_context")))


def pii_report(chunks: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per document: chunks dropped for personal data and whether a review is due."""
    dirty = (~quality.is_clean(F.col("exact_context"))).cast("bigint")
    return (
        chunks.select("document_id", dirty.alias("dirty"))
        .groupBy("document_id")
        .agg(F.sum("dirty").alias("dropped"), F.count("*").alias("total"))
        .withColumn("review", F.col("dropped") / F.col("total") > cfg.pii_review_ratio)
    )


def chunk_index(chunks: DataFrame) -> DataFrame:
    """Per-document chunk count and content digest.

    Chunks of one document come from one bounded row, so collecting their hashes per
    document stays small.
    """
    per_document = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.collect_list("content_hash").alias("hashes")
    )
    return per_document.select(
        "document_id",
        F.concat(F.lit("data/chunks/"), identity.safe_name(F.col("document_id")), F.lit(".jsonl")).alias(
            "chunk_file"
        ),
        "chunk_count",
        identity.combined_hash(F.col("hashes")).alias("content_hash"),
    )


def chunk_total(chunks: DataFrame) -> DataFrame:
    """Corpus totals beside the per-document index."""
    per_document = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return per_document.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks")
    )


def checkpoints(chunks: DataFrame, catalog: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """What was chunked and from which version of the document."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return catalog.join(counts, "document_id").select(
        "document_id",
        F.col("ingested_at").alias("source_ingested_at"),
        "chunk_count",
        F.lit(cfg.pipeline_version).alias("pipeline_version"),
    )


def pending_documents(catalog: DataFrame, done: DataFrame) -> DataFrame:
    """Documents never chunked or ingested again since."""
    from docloom.functions.dates import parse_instant

    seen = done.select("document_id", "source_ingested_at")
    return (
        catalog.join(seen, "document_id", "left")
        .filter(
            F.col("source_ingested_at").isNull()
            | (parse_instant(F.col("ingested_at")) > parse_instant(F.col("source_ingested_at")))
        )
        .drop("source_ingested_at")
    )

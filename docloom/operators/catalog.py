"""The document catalog: listing, counting, ranking, upsert and retention."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.functions import identity, quality
from docloom.functions.dates import catalog_date
from docloom.functions.urls import content_type
from docloom.operators.merge import first_of_each_key
from docloom.operators.ranking import global_rank
from docloom.session import keep_derived, let


def matching(
    catalog: DataFrame, source_org: str | None = None, target_date: date | str | None = None
) -> DataFrame:
    """Documents of one organisation and/or one publication day."""
    out = catalog
    if source_org:
        out = out.filter(F.lower("source_org") == source_org.lower())
    if target_date:
        out = out.filter(F.substring("publication_date", 1, 10) == str(target_date)[:10])
    return out


def listing(catalog: DataFrame, source_org=None, target_date=None) -> DataFrame:
    """Matching documents, most recently ingested first."""
    return matching(catalog, source_org, target_date).orderBy(
        F.col("ingested_at").desc(), F.col("document_id")
    )


def count(catalog: DataFrame, source_org=None, target_date=None) -> DataFrame:
    return matching(catalog, source_org, target_date).agg(F.count("*").alias("documents"))


def lookup(catalog: DataFrame, document_id) -> DataFrame:
    """One document by id (a string or a scalar column)."""
    return catalog.filter(F.col("document_id") == document_id).limit(1)


def oldest_date(catalog: DataFrame, source_org: str | None = None) -> DataFrame:
    return matching(catalog, source_org).agg(
        F.min(catalog_date(F.col("publication_date"))).alias("oldest")
    )


def date_has_documents(catalog: DataFrame, target_date, source_org=None) -> DataFrame:
    return count(catalog, source_org, target_date).select(
        (F.col("documents") > 0).alias("has_documents")
    )


def rank_newest_first(catalog: DataFrame) -> DataFrame:
    """``chronological_rank`` 1..n by publication date, then ingestion time, newest first."""
    order = [F.col("publication_date").desc(), F.col("ingested_at").desc(), F.col("document_id").asc()]
    return global_rank(catalog.drop("chronological_rank"), order, "chronological_rank")


def newest(catalog: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest documents as a distributed top-k."""
    return catalog.orderBy(
        F.col("publication_date").desc(), F.col("ingested_at").desc(), F.col("document_id")
    ).limit(n)


def upsert(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace rows with the same document_id, append the rest, rank again.

    Of several incoming rows for one document the latest ingestion stays (of equal ones
    the smallest title, then link).  Rows without a document_id are all added.
    """
    incoming = first_of_each_key(incoming, "document_id", [F.col("ingested_at").desc_nulls_last(), F.col("document_title"), F.col("source_url")])
    kept = catalog.drop("chronological_rank").join(
        incoming.select("document_id"), "document_id", "left_anti"
    )
    return rank_newest_first(kept.unionByName(incoming.drop("chronological_rank")))


def retain_newest(catalog: DataFrame, max_documents: int | None):
    """Split a catalog into the newest ``max_documents`` (None: all) and the tombstones of the rest."""
    cap = 1 << 62 if max_documents is None else max_documents
    ranked = rank_newest_first(catalog)
    kept = ranked.filter(F.col("chronological_rank") <= cap)
    removed = ranked.filter(F.col("chronological_rank") > cap).select("document_id")
    return kept, removed


def new_records(discovered: DataFrame, ingested_at: str) -> DataFrame:
    """Discovered items (with their ``position``) to catalog rows."""
    kind = F.coalesce(F.col("content_type"), content_type(F.col("source_url")))
    doc = identity.document_id(F.col("source_url"), F.col("document_title"))
    return discovered.select(
        doc.alias("document_id"),
        "source_org",
        "source_url",
        "document_title",
        "publication_date",
        F.lit(ingested_at).alias("ingested_at"),
        kind.alias("content_type"),
        identity.local_path(F.col("source_org"), doc, kind).alias("local_path"),
        "position",
    )


def admit(
    discovered: DataFrame, catalog: DataFrame, ingested_at: str, *, max_per_source: int | None = None
) -> DataFrame:
    """Distinct discovered documents with their ``outcome`` and number of ``occurrences``.

    The first occurrence by position wins.  It is picked by an aggregate, so a document
    listed very many times is reduced before the shuffle.
    """
    rows = new_records(discovered, ingested_at)
    if max_per_source is not None:
        by_source = Window.partitionBy("source_org").orderBy(
            F.col("publication_date").desc(), "position"
        )
        rows = rows.withColumn("_n", F.row_number().over(by_source)).filter(
            F.col("_n") <= max_per_source
        ).drop("_n")
    fields = F.struct(*[c for c in rows.columns if c != "document_id"])
    first = (
        rows.groupBy("document_id")
        .agg(F.min_by(fields, "position").alias("r"), F.count("*").alias("occurrences"))
        .select("document_id", "r.*", "occurrences")
    )
    known = catalog.select("document_id", F.lit(True).alias("_known"))
    return (
        first.join(known, "document_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("_known").isNotNull(), "skipped_existing")
            .when(
                ~quality.is_clean(F.concat_ws(" ", "document_title", "source_url")), "skipped_pii"
            )
            .otherwise("ingested"),
        )
        .drop("_known")
    )


def admission_counts(admitted: DataFrame) -> DataFrame:
    """Run counters: repeated items of a batch count as already existing."""
    repeats = F.when(F.col("outcome") == "ingested", F.col("occurrences") - 1).otherwise(
        F.when(F.col("outcome") == "skipped_existing", F.col("occurrences")).otherwise(0)
    )
    return admitted.agg(
        F.count_if(F.col("outcome") == "ingested").alias("ingested"),
        F.coalesce(F.sum(repeats), F.lit(0)).alias("skipped_existing"),
        F.coalesce(
            F.sum(F.when(F.col("outcome") == "skipped_pii", F.col("occurrences"))), F.lit(0)
        ).alias("skipped_pii"),
    )


def files_with_log(files: DataFrame, log: DataFrame) -> DataFrame:
    """Stored files (path) with the latest log row of their document, if there is one.

    A file is named after its document id with ':' as '_', so the match is an equality.
    Columns: path, document_id, ingested_at, known.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    latest = log.groupBy("document_id").agg(F.max("ingested_at").alias("ingested_at")).withColumn(
        "_stem", F.translate("document_id", ":", "_"))
    return files.withColumn("_stem", stem).join(latest, "_stem", "left").select(
        "path", "document_id", "ingested_at", F.col("document_id").isNotNull().alias("known"))


def best_chunk_per_document(chunks: DataFrame) -> DataFrame:
    """The most substantive chunk of each document: longest, abstracts preferred.

    ``max_by`` aggregates map-side, so a document with very many chunks sends one
    candidate per partition.
    """

    def candidate(text: Column) -> Column:
        bonus = F.when(F.contains(F.lower(F.substring(text, 1, 200)), F.lit("abstract")), 500)
        return F.struct(
            text.alias("_text"), (F.length(text) + F.coalesce(bonus, F.lit(0))).alias("score")
        )

    def usable(row: Column) -> Column:
        text = row["_text"]
        return (text != "") & ~quality.is_placeholder(text) & ~quality.is_boilerplate(text)

    columns = [
        "document_id", "chunk_id", "source_org", "source_url", "document_title",
        "publication_year", "page_number", "chunk_index",
    ]
    rows = keep_derived(chunks, let(F.trim("exact_context"), candidate), usable, columns)
    payload = F.struct(
        "chunk_id", "source_org", "source_url", "document_title", "publication_year",
        "page_number", F.col("_text").alias("exact_context"), "score",
    )
    # First of the best in reading order: page, then number on the page.
    order = F.struct("score", -F.col("page_number"), -F.col("chunk_index"))
    return (
        rows.groupBy("document_id").agg(F.max_by(payload, order).alias("c"))
        .select("document_id", "c.*")
        .withColumn(
            "document_title",
            quality.resolve_title(
                F.col("document_title"), F.col("source_url"), F.col("exact_context")
            ),
        )
    )


def representative_hits(
    catalog: DataFrame, chunks: DataFrame, source_org=None, target_date=None, max_documents: int = 6
) -> DataFrame:
    """One chunk per matching document, newest ingestion first, distance by position."""
    docs = matching(catalog, source_org, target_date).select("document_id", "ingested_at")
    best = best_chunk_per_document(chunks.join(docs.select("document_id"), "document_id", "left_semi"))
    top = (
        best.join(docs, "document_id")
        .orderBy(F.col("ingested_at").desc(), "document_id")
        .limit(max_documents)
    )
    order = Window.orderBy(F.col("ingested_at").desc(), "document_id")  # at most max_documents rows
    return top.withColumn("rank", F.row_number().over(order)).withColumn(
        "distance", (F.col("rank") - 1) * F.lit(0.01)
    )

"""The data model derived by Spark from the given tables.

``documents`` become catalog rows and chunks, ``conversations`` become questions and
sessions; every derived row is a function of a given row, so all work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import identity
from docloom.functions.text import strip
from docloom.functions.urls import content_type
from docloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def with_catalog_columns(docs: DataFrame) -> DataFrame:
    """Catalog columns beside the document text."""
    d = F.col("doc_id")
    org = F.when(d % 5 == 0, "DHR").when(d % 5 == 1, "ICMR").otherwise("Nature")
    out = docs.withColumn("source_org", org).withColumn(
        "source_url",
        F.when(
            F.col("source_org") == "Nature",
            F.concat(
                F.lit("https://www.nature.com/articles/s41467-026-"),
                F.lpad(d.cast("string"), 7, "0"), F.lit("-"), (d % 10).cast("string"),
            ),
        )
        .when(
            F.col("source_org") == "DHR",
            F.concat(F.lit("https://htain.dhr.gov.in/docs/"), d.cast("string"), F.lit(".pdf")),
        )
        .otherwise(F.concat(F.lit("https://www.icmr.gov.in/reports/"), d.cast("string"))),
    )
    out = out.withColumn(
        "document_title", strip(F.split_part("text", F.lit("\n"), F.lit(1)))
    )
    doc = identity.document_id(F.col("source_url"), F.col("document_title"))
    return out.withColumns(
        {
            "document_id": doc,
            "publication_date": F.when(d % 41 == 7, F.lit("2026-13-40")).otherwise(
                F.date_format(F.date_sub(F.to_date(F.lit("2026-06-01")), (d % 30).cast("int")), "yyyy-MM-dd")
            ),
            "ingested_at": F.concat(
                F.lit("2026-06-0"), (d % 9 + 1).cast("string"), F.lit("T"),
                F.lpad((d % 24).cast("string"), 2, "0"), F.lit(":00:00Z"),
            ),
            "content_type": content_type(F.col("source_url")),
            "local_path": F.concat(
                F.lit("data/corpus/"),
                identity.local_path(F.col("source_org"), doc, content_type(F.col("source_url"))),
            ),
        }
    )


CATALOG = (
    "doc_id", "document_id", "source_org", "source_url", "document_title", "publication_date",
    "ingested_at", "content_type", "local_path",
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_catalog_columns(documents(spark, sf_dir)).select(*CATALOG)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    rows = with_catalog_columns(documents(spark, sf_dir))
    return rows.select(
        F.concat("document_id", F.lit("::p0001::c0001")).alias("chunk_id"),
        "document_id", "source_org", "source_url", "document_title",
        F.substring("publication_date", 1, 4).cast("int").alias("publication_year"),
        F.lit(1).alias("page_number"), F.lit(1).alias("chunk_index"),
        F.col("text").alias("exact_context"), F.lit("unverified").alias("verification_status"),
        identity.content_hash(F.col("text")).alias("content_hash"), "doc_id", "lang", "source",
    )


def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with the document text as page 1, given some section structure.

    The given prose has no headings; one is put before every line, of a kind that
    depends on the document, so that section detection has something to find.
    """
    heading = (
        F.when(F.col("doc_id") % 4 == 0, F.lit("\nRESULTS:\n"))
        .when(F.col("doc_id") % 4 == 1, F.lit("\n\n2.1 Findings\n"))
        .when(F.col("doc_id") % 4 == 2, F.lit("\n## Notes on dosing\n"))
        .otherwise(F.lit("\n"))
    )
    rows = with_catalog_columns(documents(spark, sf_dir))
    return rows.select(
        *CATALOG, F.replace(F.col("text"), F.lit("\n"), heading).alias("text")
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns rewritten as the kinds of question the corpus is asked."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    docs = with_catalog_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "document_id", "document_title", "publication_date",
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("second_line"),
    )
    kind = (F.col("conv_id") + F.col("turn")) % 10
    word = F.split_part("document_title", F.lit(" "), F.lit(2))
    day = F.col("publication_date")
    text = (
        F.when(kind == 0, F.concat(F.lit("how many articles were published on nature on "), day))
        .when(kind == 1, F.concat(F.lit("Show nature articles published on "), day))
        .when(
            kind == 2,
            F.concat(F.lit("list articles published on "), day, F.lit(" about "), word),
        )
        .when(
            kind == 3, F.concat(F.lit("Summarize the clinical findings of "), F.col("document_title"))
        )
        .when(
            kind == 4,
            F.concat(F.col("document_title"), F.lit(" treatment. Published: "), day),
        )
        .when(kind == 5, F.col("text"))
        .when(
            kind == 6,
            F.concat(F.lit("How much pizza can a kid eat with "), F.col("text")),
        )
        .when(kind == 7, F.concat(F.lit("Which treatment is described for "), F.col("document_title")))
        .when(kind == 8, F.concat(F.lit("quantum computing of "), F.col("text")))
        .otherwise(
            F.concat(F.lit("Explain the health research on "), F.col("second_line"))
        )
    )
    return turns.join(docs, turns["conv_id"] == docs["doc_id"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "conv_id", "turn",
        text.alias("question"), "document_id",
    )


__all__ = [
    "CATALOG", "catalog", "chunk_source", "document_chunks", "documents",
    "events_log", "questions", "table", "with_catalog_columns",
]

"""Raw document files to pages, by content type."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT, Settings
from docloom.functions.html import text_pages
from docloom.functions.text import normalize_page_text
from docloom.functions.urls import is_pdf_content

CONTENT_TYPES = ("pdf", "html")


def read_files(spark: SparkSession, path: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Files with path, length, content; one beyond the size cap has no content, which is not read."""
    limit = cfg.max_download_mb * 1024 * 1024
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = files.filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= limit).select("path", "length", "content").unionByName(large)


def pdf_pages(content: bytes) -> list[dict]:
    """Text of each page, 1-based, blank pages dropped; needs a PDF library."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            texts = [page.extract_text() or "" for page in pdf.pages]
    except ImportError:
        from pypdf import PdfReader

        reader = PdfReader(io.BytesIO(content))
        if reader.is_encrypted and not reader.decrypt(""):
            raise ValueError("encrypted PDF")
        texts = [page.extract_text() or "" for page in reader.pages]
    return [{"page_number": i, "text": t} for i, t in enumerate(texts, start=1) if t.strip()]


PAGES_TYPE = T.ArrayType(T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(PAGES_TYPE)
def extract_pdf(content: pd.Series) -> pd.Series:
    def one(data):
        try:
            return pdf_pages(bytes(data)) if data is not None else None
        except Exception:  # one unreadable file must not fail the run; it becomes an error row
            return None

    return content.map(one)


def with_file_pages(rows: DataFrame, pdf_extractor=extract_pdf) -> DataFrame:
    """Add ``pages`` and ``error`` to rows with path, content and content_type; a path is one file.

    The two kinds are separated first, so each extractor only sees its own files.
    """

    def finish(df: DataFrame, pages, reason) -> DataFrame:
        normal = F.transform(
            F.coalesce(pages, F.array().cast("array<struct<page_number:int,text:string>>")),
            lambda p: F.struct(
                p["page_number"].alias("page_number"),
                normalize_page_text(p["text"], compose=False).alias("text"),
            ),
        )
        out = df.withColumn("pages", F.filter(normal, lambda p: p["text"] != ""))
        missing = F.when(F.col("content").isNull(), "content beyond the size cap").otherwise(reason)
        return out.withColumn("error", F.when(F.size("pages") == 0, missing))

    html = rows.filter(F.col("content_type") == "html")
    texts = html.select("path", F.decode("content", "UTF-8").alias("html"))
    found = text_pages(texts, ["path"]).withColumnRenamed("pages", "_pages")
    parts = finish(html.join(found, "path", "left"), F.col("_pages"), F.lit("no text extracted")).drop("_pages")
    pdf = rows.filter(F.col("content_type") == "pdf")
    valid = F.when(is_pdf_content(F.col("content")), F.col("content"))
    reason = F.when(is_pdf_content(F.col("content")), "no text extracted").otherwise("not a PDF")
    parts = parts.unionByName(finish(pdf, pdf_extractor(valid), reason))
    other = rows.filter(~F.col("content_type").isin(*CONTENT_TYPES))
    nothing = F.array().cast("array<struct<page_number:int,text:string>>")
    return parts.unionByName(
        other.withColumn("pages", nothing).withColumn(
            "error", F.concat(F.lit("unsupported content type: "), F.col("content_type"))
        )
    )

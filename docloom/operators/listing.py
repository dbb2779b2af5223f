"""Listing pages to discovered items, and the bounded crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.dates import listing_date, year_as_date
from docloom.functions.html import anchors
from docloom.functions.urls import absolute_url, content_type
from docloom.session import let

ITEM = ("source_org", "source_url", "document_title", "publication_date", "content_type", "position")
# Positions of one page lie below this; those of a second kind of rows lie behind all of the first.
PAGE_STEP = 2**32
AFTER_ALL = 2**62


def with_anchors(pages: DataFrame, page_order: str, markup: str = "html") -> DataFrame:
    """One row per link with a position that follows page order, then document order.

    ``page_order`` numbers the pages, each once, below 2^29; a page may hold 2^32 links.
    """
    links = anchors(pages.select(F.col(page_order).alias("page_order"), markup), ["page_order"], markup)
    return links.withColumn("position", F.col("page_order").cast("bigint") * PAGE_STEP + F.col("position"))


def first_by_url(items: DataFrame) -> DataFrame:
    """The first item of each address; an aggregate, so a repeated link is no hot spot."""
    rest = F.struct(*[c for c in items.columns if c != "source_url"])
    return items.groupBy("source_url").agg(F.min_by(rest, "position").alias("r")).select(
        "source_url", "r.*"
    ).select(*items.columns)


def _stem(url):
    name = F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def journal_items(links: DataFrame) -> DataFrame:
    """Article links of a journal listing, dated by their enclosing article element."""
    href = F.split_part("href", F.lit("?"), F.lit(1))
    path = F.coalesce(F.try_parse_url(absolute_url(fv.ARTICLE_BASE, href), F.lit("PATH")), F.lit(""))
    title = F.coalesce(F.nullif("text", F.lit("")), F.lit("Nature Research Article"))
    rows = links.filter(F.contains("href", F.lit("/articles/"))).select(
        F.lit("Nature").alias("source_org"),
        F.concat(F.lit(fv.ARTICLE_BASE), path).alias("source_url"),
        title.alias("document_title"),
        F.coalesce(
            F.nullif(F.substring("article_time", 1, 10), F.lit("")), F.lit("2026-06-01")
        ).alias("publication_date"),
        F.lit("html").alias("content_type"),
        "position",
        path.alias("_path"),
    )
    kept = rows.filter(
        F.col("_path").rlike(f"(?i){fv.ARTICLE_PATH}") & (F.length("document_title") >= 8)
    ).drop("_path")
    return first_by_url(kept.withColumn("document_title", F.substring("document_title", 1, 280)))


def publication_items(links: DataFrame) -> DataFrame:
    """PDF links plus publication rows; the PDF form of an address wins."""
    pdf_url = absolute_url(fv.DHR_BASE, F.col("href"))
    pdfs = links.filter(F.contains("href", F.lit(".pdf"))).select(
        F.lit("DHR").alias("source_org"),
        pdf_url.alias("source_url"),
        F.coalesce(F.nullif("text", F.lit("")), _stem(pdf_url)).alias("document_title"),
        year_as_date(pdf_url, "2026-01-01").alias("publication_date"),
        F.lit("pdf").alias("content_type"),
        "position",
    )
    row_url = absolute_url(fv.DHR_ROW_BASE, F.col("href"))
    rows = links.filter((F.col("row_kind") == "publication") & F.col("row_first")).select(
        F.lit("DHR").alias("source_org"),
        row_url.alias("source_url"),
        F.coalesce(F.nullif("text", F.lit("")), F.lit("DHR Publication")).alias("document_title"),
        F.lit("2026-01-01").alias("publication_date"),
        content_type(row_url).alias("content_type"),
        # After every PDF link.
        (F.col("position") + F.lit(AFTER_ALL)).alias("position"),
    )
    return first_by_url(pdfs.unionByName(rows))


def priority(title, url):
    """Guideline-like documents first, calls last."""
    blob = F.lower(F.concat_ws(" ", title, url))
    n = len(fv.ICMR_PRIORITY)
    score = F.greatest(
        F.lit(0),
        *[F.when(F.contains(blob, F.lit(t)), n - i).otherwise(0) for i, t in enumerate(fv.ICMR_PRIORITY)],
    )
    return score - F.when(
        F.contains(blob, F.lit("/call/")) | F.contains(blob, F.lit("eoi")), 2
    ).otherwise(0)


def report_items(links: DataFrame, max_items: int = 20) -> DataFrame:
    """PDF reports of one host plus report rows, by priority then date."""
    url = absolute_url(fv.ICMR_BASE, F.col("href"))
    spaced = F.replace(_stem(url), F.lit("_"), F.lit(" "))
    title = let(
        F.coalesce(F.nullif("spaced_text", F.lit("")), spaced),
        lambda t: F.when(F.length(t) < 4, spaced).otherwise(t),
    )
    pdfs = links.filter(
        F.lower("href").endswith(".pdf") & (F.try_parse_url(url, F.lit("HOST")) == fv.ICMR_HOST)
    ).select(
        F.lit("ICMR").alias("source_org"),
        url.alias("source_url"),
        F.substring(title, 1, 240).alias("document_title"),
        F.coalesce(listing_date(title), year_as_date(url, "2026-01-01")).alias("publication_date"),
        F.lit("pdf").alias("content_type"),
        "position",
    )
    rows = links.filter((F.col("row_kind") == "report") & F.col("row_first")).select(
        F.lit("ICMR").alias("source_org"),
        url.alias("source_url"),
        F.coalesce(F.nullif(F.coalesce("row_title", "text"), F.lit("")), F.lit("ICMR Report")).alias(
            "document_title"
        ),
        F.coalesce(listing_date(F.col("row_date")), F.lit("2026-01-01")).alias("publication_date"),
        F.lit("pdf").alias("content_type"),
        (F.col("position") + F.lit(AFTER_ALL)).alias("position"),
    )
    items = first_by_url(pdfs.unionByName(rows))
    return items.orderBy(
        priority(F.col("document_title"), F.col("source_url")).desc(),
        F.col("publication_date").desc(),
        "position",
    ).limit(max_items)


def newest_items(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy(F.col("publication_date").desc(), "position").limit(limit)


def paged_discovery(items: DataFrame, max_items: int | None = None) -> DataFrame:
    """Items of consecutive listing pages up to the first page that brings nothing new.

    ``page_order`` counts from 1; reading ends at a gap.  With ``max_items`` it also ends
    after the page that reaches the cap.  Every page before the end brings an item, so the
    cap lies within ``max_items`` pages, and only those are windowed; otherwise the end is
    two aggregates.
    """
    page = F.col("page_order").alias("page")
    first_seen = items.groupBy("source_url").agg(F.min("page_order").alias("page"))
    pages = items.select(page).distinct()
    stale = pages.join(first_seen.select("page").distinct(), "page", "left_anti")
    gaps = pages.join(pages.select((F.col("page") - 1).alias("page")), "page", "left_anti")
    ends = stale.union(gaps)
    if max_items is not None:
        fresh = first_seen.filter(F.col("page") <= max_items).groupBy("page").agg(F.count("*").alias("fresh"))
        seen = F.sum("fresh").over(Window.orderBy("page"))
        ends = ends.union(fresh.withColumn("seen", seen).filter(F.col("seen") >= max_items).select("page"))
    last = ends.agg(F.min("page")).scalar()
    first = pages.agg(F.min("page")).scalar()
    kept = first_by_url(items.filter((F.col("page_order") <= last) & (first == 1)).drop("page_order"))
    return kept if max_items is None else newest_items(kept, max_items)


def crawl(links: DataFrame, start: DataFrame, max_hops: int = 1) -> DataFrame:
    """Pages reachable from ``start`` (url) over ``links`` (page_url, target) in few hops.

    A frontier iteration: each hop joins new pages with their links and drops pages seen
    before; every hop is checkpointed so that the plan stays short.
    """
    spark = links.sparkSession
    seen = start.select("url").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = (
            links.join(frontier.select(F.col("url").alias("page_url")), "page_url")
            .select(F.col("target").alias("url"))
            .distinct()
            .join(seen.select("url"), "url", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        if spark.sparkContext.getCheckpointDir():
            found = found.checkpoint()
        seen = seen.unionByName(found)
        frontier = found
    return seen

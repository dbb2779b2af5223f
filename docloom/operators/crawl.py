"""Pages and PDF files that a site's start pages lead to, over a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# What is neither a page nor a PDF.
ASSETS = (".jpg", ".png", ".css", ".js")
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>"""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def resolved(page: Column, href: Column) -> Column:
    """A link's address as seen from its page: absolute, scheme-relative, rooted, query, or beside the page."""
    plain = F.regexp_replace(page, r"[?#].*$", "")
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(F.length(plain) > F.length(root), F.regexp_replace(plain, r"[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", "")))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_url, position, target and title of every anchor with an address, in document order.

    Fragments of the same page are no links.  Null markup has none.  The title is the
    anchor's text without markup, its white space folded.
    """
    anchors = F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(0))
    rows = pages.select(F.col(url).alias("page_url"), F.posexplode(anchors).alias("position", "anchor"))
    href = F.trim(F.coalesce(F.nullif(F.regexp_extract("anchor", _ANCHOR, 1), F.lit("")), F.regexp_extract("anchor", _ANCHOR, 2)))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("anchor", _ANCHOR, 3), r"(?s)<[^>]*>", " "), r"\s+", " "))
    found = rows.select("page_url", "position", href.alias("href"), text.alias("title")).where((F.col("href") != "") & ~F.col("href").startswith("#"))
    return found.select("page_url", "position", resolved(F.col("page_url"), F.col("href")).alias("target"), "title")


def crawl(links: DataFrame, start: DataFrame, site: str, *, max_pages: int | None = None, max_pdfs: int | None = None, max_hops: int | None = None) -> DataFrame:
    """url, kind (page or pdf), hop and title of what ``start`` (url, and optionally position) leads to on one host.

    Breadth first over ``links`` (page_url, position, target, title): each hop joins the new
    pages with their links, keeps those to ``site``'s host, sets PDF files apart, skips
    assets and other schemes, and drops what was seen before.  The visited set is a table;
    a hop costs one join with the links and one with that table, whatever cycles there are,
    and is written so that the plan stays one hop long.  A page is visited at its smallest
    hop.  A start address is visited wherever it is; one without links is a page, too.

    ``max_pages`` keeps the first pages in the order of a queue: by hop, then by the order
    of the page that links to it, then by position; pages without a limit need no order.
    ``max_pdfs`` keeps the first PDF files in that order.  A PDF's title is its first
    anchor's text, else the last part of its path.  Null addresses are ignored.
    """
    ordered = max_pages is not None or max_pdfs is not None
    home = host(F.lit(site))
    lower = F.lower("target")
    own = links.where(F.col("page_url").isNotNull() & F.col("target").isNotNull() & (host(F.col("target")) == home)).withColumn(
        "kind", F.when(lower.endswith(".pdf"), "pdf").when(lower.rlike("^https?:") & ~F.lower("target").rlike("(" + "|".join(a.replace(".", r"\.") for a in ASSETS) + ")$"), "page")
    ).where(F.col("kind").isNotNull()).select("page_url", "position", "target", "kind", "title")
    # Every hop reads the links; what they are derived from is read once.
    own = materialize(own)
    first = start.select("url", *(["position"] if "position" in start.columns else [F.lit(0).alias("position")])).where(F.col("url").isNotNull())
    # At most max_pages rows are numbered in one window.
    by_place = Window.orderBy("parent", "position", "url")

    def numbered(rows: DataFrame, room: int | None, before: int) -> DataFrame:
        if not ordered:
            return rows.withColumn("place", F.lit(0).cast("long"))
        if room is not None:
            rows = rows.orderBy("parent", "position", "url").limit(room)
        return rows.withColumn("place", F.row_number().over(by_place).cast("long") + before)

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("url").agg(F.min(F.struct("parent", "position")).alias("at")).select("url", "at.parent", "at.position")

    frontier = materialize(numbered(once(first.withColumn("parent", F.lit(0).cast("long"))), max_pages, 0).withColumn("hop", F.lit(0)))
    visited, files, hop, count = frontier, None, 0, None
    while True:
        if max_pages is not None:
            count = visited.count()
        reached = own.join(frontier.select(F.col("url").alias("page_url"), F.col("place").alias("parent")), "page_url")
        pdfs = materialize(reached.where("kind = 'pdf'").select(F.col("target").alias("url"), F.lit(hop).alias("hop"), "parent", "position", "title"))
        files = pdfs if files is None else files.unionByName(pdfs)
        if hop == max_hops or (max_pages is not None and count >= max_pages):
            break
        fresh = once(reached.where("kind = 'page'").select(F.col("target").alias("url"), "parent", "position")).join(visited.select("url"), "url", "left_anti")
        hop += 1
        frontier = materialize(numbered(fresh, None if max_pages is None else max_pages - count, count or 0).withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    best = files.groupBy("url").agg(F.min(F.struct("hop", "parent", "position", F.col("title"))).alias("b"))
    name = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)
    named = best.select("url", F.lit("pdf").alias("kind"), "b.hop", F.coalesce(F.nullif("b.title", F.lit("")), name).alias("title"), "b.parent", "b.position")
    if max_pdfs is not None:
        named = named.orderBy("parent", "position", "url").limit(max_pdfs)
    return visited.select("url", F.lit("page").alias("kind"), "hop", F.lit(None).cast("string").alias("title")).unionByName(named.drop("parent", "position"))

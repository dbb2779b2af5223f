"""Web pages to text pages, links and article bodies, with DataFrame functions only.

A page is split into tokens, each a tag and the text behind it.  Running sums number the
nesting of every kind of tag, so an opening and its closing tag are neighbours within
(page, tag, level), and an element covers the tokens between them.  All of it happens in
windows inside a page, after one exchange by the page's key.

Defined cases: an element that is never closed ends at the next tag; a closing tag
without an opening one is ignored; markup that is null or empty has no tokens.  The key
must not be null and must name one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.text import nfc, normalize_page_text, strip
from docloom.session import let

_RAW_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?</\1\s*>"
# A quote that does not end before the next "<" is no quote.
_TAG = r"""<[A-Za-z/!?](?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|<[A-Za-z/!?][^<>]*+>?"""
_TOKEN = rf"(?:{_TAG})[^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+"
_REFERENCE = r"&#?[A-Za-z0-9]++;|[^&]++|&"

# Pages whose tokens a task sorts and whose texts it composes: its memory does not grow with the table.
TASK_PAGES = 500

# Never part of a text.
_PAGE_END = "\x1e"
PAGES = "array<struct<page_number:int,text:string>>"


def unescape(text: Column) -> Column:
    """Text with its character references resolved; unknown ones stay as they are."""
    named = F.create_map(*[F.lit(v) for pair in fv.CHARACTER_REFERENCES for v in pair])

    def one(piece):
        number = F.coalesce(
            F.regexp_extract(piece, r"^&#(\d{1,9});$", 1).try_cast("int"),
            F.conv(F.nullif(F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]{1,7});$", 1), F.lit("")), 16, 10).try_cast("int"),
        )
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return (
            F.when(~piece.startswith("&"), piece)
            .when(number.isNotNull(), point)
            .otherwise(F.coalesce(F.try_element_at(named, piece), piece))
        )

    pieces = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def _attribute(name: str, mark="opened") -> Column:
    value = F.regexp_extract(mark, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.btrim(value, F.lit("\"'"))


def _classes() -> Column:
    return F.split(_attribute("class"), r"\s+")


def _has_class(*names: str) -> Column:
    return F.arrays_overlap(_classes(), F.array(*[F.lit(n) for n in names]))


def _tasks(pages: DataFrame) -> int:
    """Partitions of ``TASK_PAGES`` rows; no fewer than Spark would make."""
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // TASK_PAGES))


def elements(pages: DataFrame, key: list[str], markup: str = "html") -> DataFrame:
    """One row per token: key, pos, mark (the tag as written), tag, step, raw, opened, closed, end.

    ``step`` is 1 for an opening tag, -1 for a closing one and 0 for a void one; ``raw`` is the
    text behind the tag; ``opened`` is the opening tag of the element that the token opens or
    closes; ``closed`` tells whether it has both; ``end`` is the position behind an opened
    element's last token, seen from its opening tag.
    """
    whole = F.concat(F.lit("<!>"), F.regexp_replace(markup, _RAW_TEXT, " "))
    tokens = pages.filter(F.col(markup) != "").select(
        *key, F.posexplode(F.regexp_extract_all(whole, F.lit(_TOKEN), F.lit(0))).alias("pos", "token")
    )
    tokens = tokens.withColumn("mark", F.regexp_extract("token", f"^(?:{_TAG})", 0))
    tag = F.lower(F.regexp_extract("mark", r"^</?([A-Za-z][^\s/>]*)", 1))
    tokens = tokens.select(
        *key, "pos", "mark", tag.alias("tag"), F.substr("token", F.length("mark") + 1).alias("raw")
    )
    step = (
        F.when(F.col("mark").startswith("</"), -1)
        .when(F.col("tag").isin("", *fv.VOID_TAGS) | F.col("mark").endswith("/>"), 0)
        .otherwise(1)
    )
    tokens = tokens.withColumn("step", step).repartition(_tasks(pages), *key)
    level = F.sum("step").over(Window.partitionBy(*key, "tag").orderBy("pos"))
    # A closing tag lies on the level of the tag it closes; void tags on none.
    level = F.when(F.col("step") != 0, level + (F.col("step") == -1).cast("int"))
    same = Window.partitionBy(*key, "tag", "level").orderBy("pos")
    opens, closes = F.col("step") == 1, F.col("step") == -1
    before = F.when(closes & (F.lag("step").over(same) == 1), F.lag("mark").over(same))
    after = F.when(opens & (F.lead("step").over(same) == -1), F.lead("pos").over(same))
    out = tokens.withColumn("level", level).select(
        *tokens.columns, F.when(closes, before).otherwise(F.col("mark")).alias("opened"), after.alias("_after"),
    )
    return out.select(
        *tokens.columns, "opened",
        F.when(closes, F.col("opened").isNotNull()).otherwise(F.col("_after").isNotNull()).alias("closed"),
        F.when(opens, F.coalesce("_after", F.col("pos") + 1)).alias("end"),
    )


def _order(key: list[str]):
    return Window.partitionBy(*key).orderBy("pos")


def _depth(kind: Column, key: list[str]) -> Column:
    return F.sum(F.when(F.col("closed") & kind, F.col("step")).otherwise(0)).over(_order(key))


def _inside(kind: Column, key: list[str]) -> Column:
    alone = kind & ~F.col("closed") & (F.col("step") == 1)
    return (_depth(kind, key) > 0) | F.coalesce(alone, F.lit(False))


def _text() -> Column:
    return strip(F.replace(unescape(F.col("raw")), F.lit(_PAGE_END), F.lit("")))


def _joined(pieces: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), separator)


def _is_chrome() -> Column:
    """Page furniture by tag, class, attribute or label; the head is no text either."""
    label = _attribute("aria-label")
    tests = _has_class(*fv.STRIP_CLASSES) | F.contains(label, F.lit(fv.STRIP_ARIA_PART))
    for name, value in fv.STRIP_ATTRIBUTES:
        tests = tests | (_attribute(name) == value)
    for part in fv.STRIP_CLASS_PARTS:
        tests = tests | F.contains(_attribute("class"), F.lit(part))
    return F.col("tag").isin("head", "title", *fv.STRIP_TAGS) | F.coalesce(tests, F.lit(False))


def text_pages(pages: DataFrame, key: list[str], markup: str = "html") -> DataFrame:
    """key and ``pages`` of normalised text, one page per heading; no row for a document without text.

    A page is what stands from one heading to the next in document order, whatever elements it
    lies in.  Text before the first heading is a page of its own, before the others; without
    headings it is the only one.  Headings without text keep their number.  Blocks are set
    apart by an empty line, pieces inside a block by a space.
    """
    seen = elements(pages, key, markup).withColumn("chrome", _is_chrome())
    seen = seen.select(*key, "pos", "tag", "step", "raw", _inside(F.col("chrome"), key).alias("hidden"))
    seen = seen.filter(~F.col("hidden"))
    heading = F.col("tag").isin(*fv.HEADING_TAGS) & (F.col("step") == 1)
    numbered = seen.select(
        *key, "pos", _text().alias("text"),
        F.sum(heading.cast("int")).over(_order(key)).cast("int").alias("section"),
        F.sum(F.col("tag").isin(*fv.BLOCK_TAGS).cast("int")).over(_order(key)).alias("block"),
    ).filter(F.col("text") != "")
    blocks = numbered.groupBy(*key, "section", "block").agg(
        _joined(F.collect_list(F.struct("pos", "text")), " ").alias("text")
    )
    sections = blocks.groupBy(*key, "section").agg(
        _joined(F.collect_list(F.struct("block", "text")), "\n\n").alias("text")
    )
    documents = sections.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("s"))
    # Composition runs in Python: once a document, behind the last exchange.
    documents = documents.select(*key, "s.section", nfc(F.array_join("s.text", _PAGE_END)).alias("text"))
    found = F.filter(
        F.zip_with("section", F.split("text", _PAGE_END), lambda n, t: F.struct(
            n.alias("page_number"), normalize_page_text(t, compose=False).alias("text"))),
        lambda p: p["text"] != "",
    )
    first = lambda ps: F.when(ps[0]["page_number"] == 0, 1).otherwise(0)
    return documents.select(*key, let(found, lambda ps: F.transform(ps, lambda p: F.struct(
        (p["page_number"] + first(ps)).alias("page_number"), p["text"].alias("text")))).cast(PAGES).alias("pages"))


def with_pages(rows: DataFrame, key: str, markup: str = "html") -> DataFrame:
    """Add ``pages`` of normalised text; a document without any text gets ``error``."""
    found = rows.join(text_pages(rows, [key], markup), key, "left")
    return found.withColumn("pages", F.coalesce("pages", F.array().cast(PAGES))).withColumn(
        "error", F.when(F.size("pages") == 0, F.lit("no text extracted"))
    )


def anchors(pages: DataFrame, key: list[str], markup: str = "html") -> DataFrame:
    """Links with an address, in document order, with the listing row and article they sit in.

    key, position (from 0), href, text and spaced_text (its pieces joined by nothing and by a space),
    article_time (the first time of the innermost article), row_kind, row_first (the row's first
    link of its kind), row_title and row_date.
    """
    row_class = _has_class("publication-item", "report-item", "views-row")
    row_class = row_class | ((F.col("tag") == "article") & _has_class("publication", "report"))
    row_class = row_class | ((F.col("tag") == "tr") & _has_class("publication-row"))
    opens = F.col("step") == 1
    href = F.when(F.col("tag") == "a", F.nullif(strip(unescape(_attribute("href"))), F.lit("")))
    tokens = elements(pages, key, markup).select(
        "*", href.alias("href"), F.coalesce(row_class, F.lit(False)).alias("is_row"),
        (opens & (F.col("tag").isin("h2", "h3") | _has_class("title"))).alias("is_title"),
        (opens & ((F.col("tag") == "time") | _has_class("date"))).alias("is_date"),
        F.when(opens & (F.col("tag") == "time"), F.nullif(_attribute("datetime"), F.lit(""))).alias("datetime"),
    )
    link = F.col("href").isNotNull()
    article = (F.col("tag") == "article")
    tokens = tokens.select(
        "*", _depth(F.col("is_row"), key).alias("row_depth"), _depth(article, key).alias("article_depth"),
        F.when(_inside(link, key), F.last(F.when(link & opens, F.col("pos")), True).over(_order(key))).alias("link"),
    )

    def innermost(kind, depth):
        start = F.last(F.when(kind & opens & F.col("closed"), F.col("pos")), True)
        return F.when(F.col(depth) > 0, start.over(Window.partitionBy(*key, depth).orderBy("pos")))

    tokens = tokens.withColumn("row", innermost(F.col("is_row"), "row_depth"))
    tokens = tokens.withColumn("article", innermost(article, "article_depth"))
    in_row = Window.partitionBy(*key, "row")
    first = lambda kind: F.min(F.when(F.col(kind), F.struct("pos", "end"))).over(in_row)
    tokens = tokens.withColumn("first_title", first("is_title")).withColumn("first_date", first("is_date"))
    own = F.col("row").isNotNull()
    covers = lambda e: own & (F.col("pos") >= F.col(e)["pos"]) & (F.col("pos") < F.col(e)["end"])
    at_link = F.col("pos") == F.col("link")
    piece = lambda keep: F.collect_list(F.when(keep & (F.col("text") != ""), F.struct("pos", "text")))
    groups = tokens.withColumn("text", _text()).groupBy(*key, "article", "row", "link").agg(
        F.max(F.when(at_link, F.col("href"))).alias("href"),
        F.max(F.when(at_link, F.col("mark"))).alias("opened"),
        F.max(F.when(F.col("pos") == F.col("row"), F.col("mark"))).alias("row_mark"),
        piece(F.col("link").isNotNull()).alias("pieces"),
        piece(covers("first_title")).alias("title"), piece(covers("first_date")).alias("date"),
        F.bool_or(own & F.col("is_title")).alias("titled"), F.bool_or(own & F.col("is_date")).alias("dated"),
        F.min(F.when(F.col("datetime").isNotNull(), F.struct("pos", "datetime"))).alias("time"),
    )
    kind = F.when(F.col("row").isNotNull(), F.when(
        F.contains(_attribute("class", F.max("row_mark").over(in_row)), F.lit("publication")), "publication").otherwise("report"))
    groups = groups.withColumn("row_kind", kind)
    report_link = F.col("href").endswith(".pdf") | F.contains("href", F.lit("/reports/")) | _has_class("report-link")
    chosen = F.when((F.col("row_kind") == "publication") | report_link, F.col("link"))
    together = lambda c, has: F.when(
        F.bool_or(has).over(in_row) & own, _joined(F.flatten(F.collect_list(c).over(in_row)), ""))
    found = groups.select(
        *key, "link", "href", "pieces", "row_kind",
        F.min("time").over(Window.partitionBy(*key, "article")).alias("time"), "article",
        F.when(own, F.coalesce(F.min(chosen).over(in_row) == F.col("link"), F.lit(False))).alias("row_first"),
        together("title", "titled").alias("row_title"), together("date", "dated").alias("row_date"),
    ).filter(F.col("link").isNotNull())
    return found.select(
        *key, (F.row_number().over(Window.partitionBy(*key).orderBy("link")) - 1).alias("position"), "href",
        _joined(F.col("pieces"), "").alias("text"), _joined(F.col("pieces"), " ").alias("spaced_text"),
        F.when(F.col("article").isNotNull(), F.col("time")["datetime"]).alias("article_time"),
        "row_kind", "row_first", "row_title", "row_date",
    )


def _escaped(text: Column) -> Column:
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def article_pages(pages: DataFrame, key: str, title: str, url: str, markup: str = "html") -> DataFrame:
    """Rows with ``article``: the page's article element in a page of its own, with title and address.

    The element is the first of the best kind: the publisher's body division, an article
    marked as body, an article inside the main element, the main element.  A page without any
    keeps its whole text.  Scripts, styles and comments are left out.
    """
    tokens = elements(pages, [key], markup)
    kind = (
        F.when((F.col("tag") == "div") & _has_class("c-article-body"), 1)
        .when((F.col("tag") == "article") & (_attribute("data-test") == "article-body"), 2)
        .when((F.col("tag") == "article") & _inside(F.col("tag") == "main", [key]), 3)
        .when(F.col("tag") == "main", 4)
    )
    rank = F.when((F.col("step") == 1) & F.col("closed"), kind)
    tokens = tokens.withColumn("rank", rank).withColumn(
        "best", F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "pos", "end"))).over(Window.partitionBy(key)))
    inside = F.col("pos").between(F.col("best")["pos"], F.col("best")["end"])
    written = F.concat("mark", F.when(F.col("pos") < F.col("best")["end"], F.col("raw")).otherwise(""))
    whole = F.when(F.col("best").isNull() & (_text() != ""), F.struct("pos", _text().alias("text")))
    bodies = tokens.groupBy(key).agg(
        _joined(F.collect_list(F.when(inside, F.struct("pos", written.alias("text")))), "").alias("_body"),
        _joined(F.collect_list(whole), " ").alias("_whole"),
    )
    inner = F.coalesce(
        F.nullif("_body", F.lit("")), F.concat(F.lit("<p>"), _escaped(F.coalesce("_whole", F.lit(""))), F.lit("</p>")))
    article = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), _escaped(F.coalesce(title, F.lit(""))),
        F.lit('</title><link rel="canonical" href="'), _escaped(F.coalesce(url, F.lit(""))),
        F.lit('"/></head><body><article data-source="nature-live">'), inner, F.lit("</article></body></html>"),
    )
    return pages.join(bodies, key, "left").withColumn("article", article).drop("_body", "_whole")


# --- metadata by pattern ---------------------------------------------------------------


def page_title(markup: Column, default: Column) -> Column:
    found = F.regexp_extract(markup, r"(?i)<title>([^<]+)</title>", 1)
    return F.substring(F.when(found != "", strip(found)).otherwise(default), 1, 280)


def page_date(markup: Column) -> Column:
    forms = (
        r"publicationDate=(\d{4}-\d{2}-\d{2})",
        r"(?is)Published[^<]*<time datetime=[\"'](\d{4}-\d{2}-\d{2})",
        r"<time datetime=\"(\d{4}-\d{2}-\d{2})\"",
    )
    found = [F.nullif(F.regexp_extract(markup, f, 1), F.lit("")) for f in forms]
    return F.coalesce(*found, F.lit("1970-01-01"))


def canonical_url(markup: Column) -> Column:
    return F.regexp_extract(markup, r"rel=\"canonical\"\s+href=\"([^\"]+)\"", 1)

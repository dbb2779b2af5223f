import json
import pathlib
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from docloom import schemas
from docloom.config import DEFAULT
from docloom.functions import html
from docloom.operators import catalog as cat
from docloom.operators import checks, listing, merge, sessions, suggestions
from docloom.plans import answer, chunk, index, ingest
from docloom.sources import files, json_tables, lake, listing_pages
from docloom.streaming import audit as audit_stream
from docloom.streaming import documents as document_stream
from docloom.streaming import sessions as session_stream
from docloom.workload import table_queries

NOW = "2026-06-02T00:00:00Z"
ARTICLE = """<html><head><title>Asthma screening accuracy in children</title><script>x()</script></head>
<body><nav>Menu</nav><article><h1>Asthma screening accuracy in children</h1><p>The <b>trial</b> enrolled patients
with asthma in three hospitals and measured screening accuracy over two years.</p><div class="c-share-box">Share</div>
<h2>Methods</h2><p>Screening used a questionnaire and spirometry for every child in the cohort.</p>
<h2>Results</h2><p>Sensitivity was high and specificity moderate across all of the hospitals.</p></article></body></html>"""
LISTING = """<article><h3><a href="/articles/s41467-026-1001-1?x=1">Asthma screening accuracy in children</a></h3>
<time datetime="2026-05-30T00:00">x</time></article>
<article><h3><a href="/articles/s41467-026-1002-2">Vaccine dose timing in older adults</a></h3><time datetime="2026-05-29">y</time></article>
<a href="/articles/s41467-026-1001-1">Asthma screening accuracy in children</a><a href="/articles/s41467-026-1003-3">short</a><a href="/about">About</a>"""


# --- web pages ------------------------------------------------------------------------


def test_html_pages_follow_headings(spark):
    rows = html.with_pages(spark.createDataFrame(
        [(1, ARTICLE), (2, "<p>only text</p>"), (3, "<nav>menu</nav>"), (4, None), (5, "")], "id int, html string"), "id")
    first, second, third, null, empty = rows.orderBy("id").collect()
    assert null.pages == empty.pages == [] and null.error and empty.error
    assert [p.page_number for p in first.pages] == [1, 2, 3]
    assert first.pages[1].text.startswith("Methods\n\nScreening used")
    assert not any("Menu" in p.text or "Share" in p.text for p in first.pages)
    assert [p.text for p in second.pages] == ["only text"]
    assert third.pages == [] and third.error


def test_markup_cases(spark):
    cases = {
        "<h1>T</h1><p><b>bold<br><p>second<ul><li>a<li>b</ul>": [(1, "T\n\nbold\n\nsecond\n\na\n\nb")],
        # text before the first heading, headings inside wrappers, headings without text
        "before<div><h2>A</h2></div><p>x</p><h3></h3><div><h2>B</h2>y</div>": [(1, "before"), (2, "A\n\nx"), (4, "B\n\ny")],
        # furniture with the same tag nested inside, and what follows it
        "<div class='c-share-box'>no<div>no</div>no</div><p>yes<p class=newsletter-box>no<p>yes": [(1, "yes\n\nyes")],
        "<form><p>no</form></form></p><p>yes</p>": [(1, "yes")],
        "<!-- <p>no --><script>if (a<b) '</p>'</script><p title='a>b'>1 < 2 &lt; 3 &#x1F600;&#233;&unknown; &#xD800;": [
            (1, "1 < 2 < 3 \U0001F600\u00e9&unknown; \ufffd")],
        "<p title=don't>a</p><p>it's</p>": [(1, "a\n\nit's")],
        "e\u0301": [(1, "\u00e9")],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, html string")
    got = {r.id: [tuple(p) for p in r.pages] for r in html.with_pages(rows, "id").collect()}
    assert got == dict(enumerate(cases.values()))


def test_very_long_page(spark):
    long = "<p class=x>word &amp; " * 50_000
    got = html.with_pages(spark.createDataFrame([(1, "<nav>" + long + "</nav><h1>T</h1>" + long)], "id int, html string"), "id").first()
    assert [len(p.text) for p in got.pages] == [1 + 50_000 * len("\n\nword &")]


def test_article_body(spark):
    rows = spark.createDataFrame([
        (1, "<main>a<article class=k><p>x &amp; y</p></article>b</main>", "T<", "http://a"),
        (2, "<div class='c-article-body'><div>in</div></div><main>out</main>", None, "http://b"),
        (3, "<p>" + "word &lt; " * 3000, "t", "http://c"), (4, None, "t", None)],
        "id int, html string, title string, url string")
    got = [r.article for r in html.article_pages(rows, "id", "title", "url").orderBy("id").collect()]
    assert '<article data-source="nature-live"><article class=k><p>x &amp; y</p></article></article>' in got[0]
    assert "<title>T&lt;</title>" in got[0] and 'href="http://a"' in got[0]
    assert "nature-live\"><div class='c-article-body'><div>in</div></div></article>" in got[1]
    assert got[2].count("word &lt;") == 3000
    assert "<p></p>" in got[3]


def test_links_of_rows(spark):
    page = """<article class="publication"><a href="/x">n<b>1</b></a><time>2024</time>
        <article><time datetime="2020-01-01">old</time><a href='/y'>in</a></article><a href="/z">z</a><time datetime="2021">t</time></article>
        <div class="views-row"><a href="/other">o</a><h2>The <i>title</i></h2><h2>second</h2><a class="report-link" href="/r">r</a></div><a>none</a><a href=" ">none</a><a href=/u>un"""
    rows = spark.createDataFrame([(7, page), (8, None)], "id int, html string")
    got = [tuple(r)[1:] for r in html.anchors(rows, ["id"]).orderBy("position").collect()]
    assert got == [
        (0, "/x", "n1", "n 1", "2021", "publication", True, None, "2024"),
        (1, "/y", "in", "in", "2020-01-01", "publication", False, None, "2024"),
        (2, "/z", "z", "z", "2021", "publication", False, None, "2024"),
        (3, "/other", "o", "o", None, "report", False, "Thetitle", None),
        (4, "/r", "r", "r", None, "report", True, "Thetitle", None),
        (5, "/u", "un", "un", None, None, None, None, None),
    ]


def test_listing_readers(spark):
    pages = spark.createDataFrame([(1, LISTING)], "page int, html string")
    got = listing.journal_items(listing.with_anchors(pages, "page")).orderBy("position").collect()
    assert [(r.source_url[-9:], r.publication_date) for r in got] == [("26-1001-1", "2026-05-30"), ("26-1002-2", "2026-05-29")]
    reports = """<a href="/call/eoi_2025.pdf">Call for EOI</a><a href="https://other.org/x.pdf">Other</a>
    <a href="/docs/guideline_2024.pdf">TB guideline 2024</a><div class="report-item"><h3>Annual</h3><a href="/reports/77">More</a><span class="date">2023-02-01</span></div>"""
    links = listing.with_anchors(spark.createDataFrame([(1, reports)], "page int, html string"), "page")
    got = listing.report_items(links).collect()
    assert [(r.document_title, r.publication_date) for r in got] == [
        ("TB guideline 2024", "2024-06-01"), ("Annual", "2023-02-01"), ("Call for EOI", "2025-06-01")]
    pubs = """<a href="a/b_2022.pdf"></a><div class="publication-item"><a href="/p/1">Policy</a></div>"""
    got = listing.publication_items(listing.with_anchors(spark.createDataFrame([(1, pubs)], "page int, html string"), "page"))
    assert {(r.document_title, r.content_type, r.publication_date) for r in got.collect()} == {
        ("b_2022", "pdf", "2022-06-01"), ("Policy", "html", "2026-01-01")}


def test_listing_source_reads_pages(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"p{n}.html").write_text(LISTING.replace("100", f"{n}00"))
    listing_pages.register(spark)
    rows = spark.read.format("listing_pages").option("url", f"file://{tmp_path}/p{{page}}.html").option("pages", 3).load()
    assert [r.page_order for r in rows.orderBy("page_order").collect()] == [1, 2]


def test_unreadable_page_fails_instead_of_ending_the_listing(spark, tmp_path):
    (tmp_path / "p1.html").write_text(LISTING)
    (tmp_path / "p2.html").mkdir()  # there, but not to be read
    (tmp_path / "p3.html").write_text(LISTING)
    listing_pages.register(spark)
    source = spark.read.format("listing_pages").option("url", f"file://{tmp_path}/p{{page}}.html").option("pages", 3).option("pause", 0)
    with pytest.raises(Exception, match="page 2 could not be read"):
        source.load().collect()


def test_listing_stream_loses_no_page(spark, tmp_path):
    """A batch with an unreadable page fails, and after a restart is read again; later pages follow."""
    listing_pages.register(spark)
    for n in (1, 3):
        (tmp_path / f"p{n}.html").write_text(f"page {n}")
    (tmp_path / "p2.html").mkdir()

    def run(pages):
        rows = spark.readStream.format("listing_pages").option("url", f"file://{tmp_path}/p{{page}}.html").option("pages", pages).option("pause", 0).load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="could not be read"):
        run(3)
    (tmp_path / "p2.html").rmdir()
    (tmp_path / "p2.html").write_text("page 2")
    run(3)
    read = lambda: sorted((r.page_order, r.html) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == [(n, f"page {n}") for n in (1, 2, 3)]
    (tmp_path / "p4.html").write_text("page 4")
    run(6)
    assert read() == [(n, f"page {n}") for n in (1, 2, 3, 4)]


def test_paged_discovery_stops(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "d")]
    items = spark.createDataFrame([(p, u, "2026-06-01", i) for i, (p, u) in enumerate(rows)],
                                  "page_order int, source_url string, publication_date string, position int")
    assert {r.source_url for r in listing.paged_discovery(items, 10).collect()} == {"a", "b", "c"}
    assert {r.source_url for r in listing.paged_discovery(items, 2).collect()} == {"a", "b"}


def test_paged_discovery_ends_at_gaps_and_repeats(spark):
    schema = "page_order int, source_url string, publication_date string, position int"

    def found(rows, cap=None):
        items = spark.createDataFrame([(p, u, "2026-06-01", i) for i, (p, u) in enumerate(rows)], schema)
        return {r.source_url for r in listing.paged_discovery(items, cap).collect()}

    assert found([(1, "a"), (2, "b"), (4, "c")]) == {"a", "b"}
    assert found([(2, "b"), (3, "c")]) == set() == found([])
    assert found([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e")], 3) == {"a", "b", "c"}
    assert found([(p, f"u{p}") for p in range(1, 40)]) == {f"u{p}" for p in range(1, 40)}


def test_ranks_and_upserts_keep_every_row(spark):
    columns = "document_id string, publication_date string, ingested_at string, document_title string, source_url string"
    rows = [("a", "2026-05-01", "2026-06-01T00:00:00Z", "t", "u"), ("b", None, "2026-06-01T00:00:00Z", "t", "u"), ("c", None, None, "t", "u")]
    catalog = spark.createDataFrame(rows, columns)
    ranked = {r.document_id: r.chronological_rank for r in cat.rank_newest_first(catalog).collect()}
    assert ranked == {"a": 1, "b": 2, "c": 3}
    kept, gone = cat.retain_newest(catalog, 1)
    assert [r.document_id for r in kept.collect()] == ["a"] and {r.document_id for r in gone.collect()} == {"b", "c"}
    assert cat.retain_newest(catalog, None)[0].count() == 3
    twice = spark.createDataFrame([("b", "2026-05-09", "2026-06-02T00:00:00Z", "old", "u"), ("b", "2026-05-09", "2026-06-03T00:00:00Z", "new", "u")], columns)
    merged = {r.document_id: r.document_title for r in cat.upsert(catalog, twice).collect()}
    assert merged == {"a": "t", "b": "new", "c": "t"} and cat.upsert(catalog, twice).count() == 3
    assert merge.upsert(catalog, twice, "document_id").count() == 3


def test_crawl_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "page_url string, target string")
    start = spark.createDataFrame([("a",)], "url string")
    got = {(r.url, r.hop) for r in listing.crawl(links, start, 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


# --- stored tables --------------------------------------------------------------------


def test_json_containers(spark, tmp_path):
    doc = {"document_id": "sha256:1", "source_org": "Nature", "source_url": "u", "document_title": "t",
           "publication_date": "2026-06-01", "ingested_at": NOW, "content_type": "html", "local_path": "p", "chronological_rank": 1}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"schema_version": "1", "documents": [doc], "pruned_document_ids": ["sha256:9"]}, indent=1))
    assert json_tables.read_catalog(spark, str(path)).first()["document_id"] == "sha256:1"
    assert json_tables.read_tombstones(spark, str(path)).first()["document_id"] == "sha256:9"
    assert json_tables.read_catalog(spark, str(tmp_path / "absent.json")).count() == 0
    path.write_text(json.dumps({"schema_version": "2", "documents": [doc]}))
    with pytest.raises(Exception, match="unsupported schema_version"):
        json_tables.read_catalog(spark, str(path)).collect()


def test_chunk_files_and_logs(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"chunk_id": "a::1", "document_id": "a"}\n\n{"chunk_id": "a::2", "document_id": "a"}\n')
    index_file = tmp_path / "index.json"
    index_file.write_text(json.dumps({"schema_version": "1", "documents": [{"document_id": "a"}, {"document_id": "missing"}]}))
    assert json_tables.read_indexed_chunks(spark, str(index_file), str(tmp_path / "c")).count() == 2
    rows = spark.createDataFrame([("a",)], "document_id string")
    from docloom.operators.audit import log_rows

    json_tables.append_log(log_rows(rows, "seen", NOW, document_id=F.col("document_id")), str(tmp_path / "log"))
    json_tables.append_log(log_rows(rows, "seen", NOW, "src"), str(tmp_path / "log"))
    got = {(r.event, r.source, r.attrs.get("document_id")) for r in json_tables.read_log(spark, str(tmp_path / "log")).collect()}
    assert got == {("seen", None, "a"), ("seen", "src", None)}
    (tmp_path / "stats.json").write_text("{broken")
    assert json_tables.read_stats(spark, str(tmp_path / "stats.json")).count() == 0


def chunk_rows(spark, *ids):
    rows = [tuple([i, i.split("::")[0]] + ["x"] * 3 + [2026, 1, 1, "text " + i, 1, 1, "unverified", "h" + i, NOW]) for i in ids]
    return spark.createDataFrame(rows, schemas.CHUNK)


def test_merge_by_document_replaces_and_empties(spark, tmp_path):
    path = str(tmp_path / "chunks")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    lake.merge_by_document(chunk_rows(spark, "a::1", "a::2", "b::1", "c::1"), ids, path, schemas.CHUNK, 4)
    lake.merge_by_document(chunk_rows(spark, "a::9"), ids.filter("document_id in ('a', 'b')"), path, schemas.CHUNK, 4)
    got = {r.chunk_id for r in lake.read_table(spark, path, schemas.CHUNK).collect()}
    assert got == {"a::9", "c::1"}
    lake.merge_by_document(chunk_rows(spark), ids, path, schemas.CHUNK, 4)
    assert lake.read_table(spark, path, schemas.CHUNK).count() == 0


def test_overwrite_may_read_its_target(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    lake.overwrite(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_files_by_content_type(spark, tmp_path):
    (tmp_path / "a.html").write_text(ARTICLE)
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "c.doc").write_text("x")
    (tmp_path / "big.html").write_bytes(b"x" * 2_000_000)
    rows = files.read_files(spark, str(tmp_path), DEFAULT.with_(max_download_mb=1)).withColumn(
        "content_type", F.element_at(F.split("path", r"\."), -1))
    got = {pathlib.Path(r.path).name: (len(r.pages), r.error) for r in files.with_file_pages(rows).collect()}
    assert got == {"a.html": (3, None), "b.pdf": (0, "not a PDF"), "c.doc": (0, "unsupported content type: doc"),
                   "big.html": (0, "content beyond the size cap")}


# --- catalog and merges ---------------------------------------------------------------


def test_retention_keeps_the_newest(spark):
    rows = [(f"sha256:{i:016x}", "Nature", "u", "t", f"2026-05-{(1000 - i) % 28 + 1:02d}", NOW, "html", "p") for i in range(1001)]
    frame = spark.createDataFrame(rows, "document_id string, source_org string, source_url string, document_title string, "
                                        "publication_date string, ingested_at string, content_type string, local_path string")
    kept, pruned = cat.retain_newest(frame, 1000)
    assert kept.count() == 1000 and pruned.count() == 1
    oldest = min(r[4] for r in rows)
    assert pruned.first()["document_id"] == max(r[0] for r in rows if r[4] == oldest)


def test_cascade(spark):
    stored = spark.createDataFrame([("k::1",), ("p::1",), ("p::2",), ("pp::1",)], "chunk_id string")
    gone = spark.createDataFrame([("p",), ("p",)], "document_id string")
    assert {r.chunk_id for r in merge.delete_documents(stored, gone).collect()} == {"k::1", "pp::1"}
    assert merge.count_deletions(stored, gone).first()["chunks_deleted"] == 2


def test_export_gate(spark):
    citations = spark.createDataFrame([("s", 1, "chunk-a"), ("s", 2, "chunk-b")], "session_id string, index int, chunk_id string")
    cited = spark.createDataFrame([("s", 2)], "session_id string, index int")
    marks = spark.createDataFrame([("s", "chunk-b"), ("other", "chunk-a")], "session_id string, chunk_id string")
    gate = sessions.export_gate(sessions.export_scope(citations, cited), marks).first()
    assert (gate.total, gate.verified, gate.allowed, list(gate.pending_indices)) == (1, 1, True, [])
    everything = sessions.export_gate(sessions.export_scope(citations, cited.limit(0)), marks).first()
    assert (everything.total, everything.allowed, list(everything.pending_indices)) == (2, False, [1])
    known = spark.createDataFrame([("s",), ("empty",)], "session_id string")
    rows = sessions.export_gate(sessions.export_scope(citations, cited), marks, known).collect()
    assert {r.session_id: r.allowed for r in rows} == {"s": True, "empty": False}


def test_modes():
    assert checks.retrieval_mode(True, DEFAULT) == "lexical"
    assert checks.retrieval_mode(False, DEFAULT) == "vector"
    assert checks.retrieval_mode(True, DEFAULT.with_(has_embedding_token=True)) == "vector"
    assert checks.retrieval_mode(True, DEFAULT.with_(embed_mock=True)) == "lexical"


# --- whole flows ----------------------------------------------------------------------


EMPTY_CATALOG = "document_id string, source_org string, source_url string, document_title string, publication_date string, ingested_at string, content_type string, local_path string"


@pytest.fixture(scope="module")
def pipeline(spark):
    """Listing page to catalog to chunks to vectors."""
    pages = spark.createDataFrame([(1, LISTING)], "page int, html string")
    found = listing.journal_items(listing.with_anchors(pages, "page"))
    none = spark.createDataFrame([], EMPTY_CATALOG)
    gone = spark.createDataFrame([], "document_id string")
    run = ingest.run(found, none, gone, ingested_at=NOW)
    catalog = run.catalog.cache()
    bodies = catalog.select("document_id", F.when(F.col("document_title").startswith("Asthma"), F.lit(ARTICLE)).otherwise(
        F.lit(ARTICLE.replace("sthma", "accine").replace("screening", "dosing"))).alias("html"))
    texts = html.with_pages(bodies, "document_id").drop("html")
    chunked = chunk.run(catalog, texts, spark.createDataFrame([], schemas.CHUNK),
                        spark.createDataFrame([], schemas.CHECKPOINT), gone, created_at=NOW)
    return run, catalog, texts, chunked


def test_ingest_flow(spark, pipeline):
    run, catalog, _, _ = pipeline
    assert run.counters.first().asDict() == {"ingested": 2, "skipped_existing": 0, "skipped_pii": 0}
    pages = spark.createDataFrame([(1, LISTING)], "page int, html string")
    again = ingest.run(listing.journal_items(listing.with_anchors(pages, "page")), catalog,
                       run.tombstones, ingested_at=NOW, max_documents=1)
    assert again.counters.first()["skipped_existing"] == 2
    assert again.catalog.count() == 1 and again.tombstones.count() == 1
    assert {r.event for r in again.log.collect()} == {"document_pruned"}


def test_chunk_flow_is_incremental(spark, pipeline):
    _, catalog, texts, first = pipeline
    assert first.pending.count() == 2 and first.chunks.count() == 6
    gone = spark.createDataFrame([], "document_id string")
    again = chunk.run(catalog, texts, first.chunks, first.checkpoints, gone, created_at=NOW)
    assert again.pending.count() == 0
    assert {r.chunk_id for r in again.chunks.collect()} == {r.chunk_id for r in first.chunks.collect()}
    forced = chunk.run(catalog, texts, first.chunks, first.checkpoints, gone, created_at=NOW, force=True)
    assert forced.pending.count() == 2 and forced.chunks.count() == 6
    pruned = catalog.limit(1).select("document_id")
    after = chunk.run(catalog, texts, first.chunks, first.checkpoints, pruned, created_at=NOW)
    assert after.chunks.select("document_id").distinct().count() == 1


def test_index_flow(spark, pipeline):
    *_, chunked = pipeline
    cfg = DEFAULT.with_(embedding_dimension=32, embed_batch_size=2)
    shape = chunked.chunks.withColumn("embedding", F.array().cast("array<double>")).limit(0)
    gone = spark.createDataFrame([], "document_id string")
    first = index.run(chunked.chunks, shape, gone, cfg=cfg)
    stats = first.stats.first()
    assert (stats.total_vectors, stats.chunks_embedded, stats.chunks_skipped_unchanged) == (6, 6, 0)
    assert first.errors.count() == 0
    vectors = first.vectors.cache()
    again = index.run(chunked.chunks, vectors, gone, cfg=cfg)
    assert again.stats.first()["chunks_skipped_unchanged"] == 6
    one = chunked.chunks.select("document_id").limit(1)
    cascade = index.run(chunked.chunks, vectors, one, prune_only=True, cfg=cfg)
    assert cascade.deleted.first()["chunks_deleted"] == 3 and cascade.vectors.count() == 3
    report = checks.verify_index(vectors, expected=chunked.chunks.agg(F.count("*").alias("total")),
                                 sample_hits=vectors.limit(1), reopened=vectors, cfg=cfg)
    assert checks.overall(report).first()["passed"], report.collect()


def test_failing_requests_are_isolated(spark, pipeline):
    *_, chunked = pipeline

    def flaky(texts):
        if any("Sensitivity" in t for t in texts):
            raise RuntimeError("busy")
        return [[1.0, 2.0]] * len(texts)

    made = index.embed(chunked.chunks.coalesce(1), flaky, DEFAULT.with_(embed_batch_size=1)).collect()
    assert len(made) == 6
    assert sum(r.error == "busy" for r in made) == sum("Sensitivity" in r.exact_context for r in made)


def test_question_flow(spark, pipeline):
    _, catalog, _, chunked = pipeline
    chunks = chunked.chunks.cache()
    doc = chunks.filter("exact_context like '%spirometry%'").first()
    rows = [
        (1, "how many articles were published on nature on 2026-05-30", None, None),
        (2, "Show nature articles published on 2026-05-30", None, None),
        (3, "list nature articles published on 2026-01-01", None, None),
        (4, "list articles published on 2026-05-30 about qwertyuiop", None, None),
        (5, "How much pizza can a kid eat", None, None),
        (6, "What does spirometry show in the clinical cohort", doc.document_id, None),
        (7, "clinical questionnaire", None, None),
        (8, "clinical questionnaire", None, "waiting"),
        (9, "Asthma screening accuracy in children clinical", None, "waiting"),
        (10, "clinical zebrafish", None, None),
    ]
    asked = spark.createDataFrame(rows, "qid int, question string, document_id string, prior_session_id string")
    known = spark.createDataFrame([("waiting", True)], "session_id string, awaiting_clarification boolean")
    got = {r.qid: r for r in answer.answer(asked, catalog, chunks, sessions=known, seed="x").collect()}
    status = {q: r.status for q, r in got.items()}
    assert status == {1: "answered", 2: "listed", 3: "date_not_found", 4: "topic_not_found", 5: "out_of_scope",
                      6: "answered", 7: "needs_clarification", 8: "out_of_corpus", 9: "answered", 10: "out_of_corpus"}
    assert got[1].indexed_count == 1 and got[1].answer.startswith("**Direct answer:** 1 indexed document(s)")
    assert [c["index"] for c in got[2].citations] == [1] and "[1]" in got[2].answer
    assert "2026-01-01" in got[3].answer and len(got[3].suggested) == 2
    assert got[6].mode == "document" and got[6].citations[0].chunk_id.startswith(doc.document_id)
    assert got[5].refused and not got[5].citations
    held = answer.new_sessions(answer.answer(asked.filter("qid = 7"), catalog, chunks, seed="x")).first()
    assert held.awaiting_clarification


def test_suggestions(spark, pipeline):
    _, catalog, _, chunked = pipeline
    newest = suggestions.follow_ups(catalog, 5, seed="s", newest_first=True).orderBy("position").collect()
    assert [r.label.split(" · ")[1] for r in newest] == ["2026-05-30", "2026-05-29"]
    prompts = suggestions.starter_prompts(catalog, chunked.chunks, seed="s").orderBy("position").collect()
    assert [r.kind for r in prompts] == ["corpus", "corpus", "off_topic"]
    assert prompts[1].query.endswith("2026-05-28")
    bare = suggestions.starter_prompts(catalog.limit(0), chunked.chunks, seed="s").orderBy("position").collect()
    assert bare[0].id == "corpus-fallback-tb-screening" or bare[0].query.startswith("What does the indexed")


# --- streams --------------------------------------------------------------------------


def test_document_stream_merges_versions(spark, pipeline, tmp_path):
    _, catalog, texts, _ = pipeline
    source, target = str(tmp_path / "in"), str(tmp_path / "chunks")
    rows = catalog.drop("chronological_rank").join(texts.select("document_id", "pages"), "document_id")
    rows.write.parquet(source)

    def run():
        stream = document_stream.read_documents(spark, source, rows.schema)
        document_stream.start_chunking(stream, target, str(tmp_path / "cp"), buckets=4).awaitTermination()
        return lake.read_table(spark, target, schemas.CHUNK).collect()

    assert len(run()) == 6
    newer = rows.filter(F.col("document_title").startswith("Asthma")).withColumn("ingested_at", F.lit("2026-06-03T00:00:00Z"))
    newer.withColumn("pages", F.slice("pages", 1, 1)).unionByName(
        rows.withColumn("ingested_at", F.lit("2026-01-01T00:00:00Z"))).write.mode("append").parquet(source)
    got = run()
    assert len(got) == 4 and {r.created_at for r in got} == {NOW, "2026-06-03T00:00:00Z"}


def test_session_stream(spark, tmp_path):
    source = str(tmp_path / "events")

    def send(*rows):
        spark.createDataFrame(rows, session_stream.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = spark.readStream.schema(session_stream.EVENTS).parquet(source)
        query = (session_stream.gate_updates(events).writeStream.outputMode("update")
                 .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "out")))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        return {r.session_id: r for r in spark.read.schema(session_stream.GATE).parquet(str(tmp_path / "out")).collect()}

    send(("s", "citation", 1, "a"), ("s", "citation", 2, "b"), ("s", "cited", 2, None), ("t", "clarify", None, None))
    got = run()
    assert (got["s"].total, got["s"].allowed, got["s"].pending) == (1, False, "2") and got["t"].awaiting_clarification
    send(("s", "verify", None, "b"), ("s", "verify", None, "unknown"))
    got = run()
    assert set(got) == {"s"} and got["s"].allowed and got["s"].verified == 1


def session_events(spark):
    """The given conversations as the events of their sessions."""
    citations, cited, marks = table_queries._session_tables(spark, SF)
    parts = [
        citations.select("session_id", F.lit("citation").alias("kind"), "index", "chunk_id"),
        cited.select("session_id", F.lit("cited").alias("kind"), "index", F.lit(None).cast("string").alias("chunk_id")),
        marks.select("session_id", F.lit("verify").alias("kind"), F.lit(None).cast("int").alias("index"), "chunk_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("session_id", F.col("session_id").cast("string"))


def test_session_stream_over_conversations(spark, tmp_path):
    """The stream's gates and its stored state are those of the batch operators over the same table."""
    session_events(spark).repartition(3).write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema(session_stream.EVENTS).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "events"))
    query = (session_stream.gate_updates(events).writeStream.outputMode("update")
             .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "out")))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.session_id, r.total, r.verified, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(str(r.session_id), r.total, r.verified, r.allowed) for r in table_queries.export_gate(spark, SF).collect()}
    stored = session_stream.stored_citations(spark, str(tmp_path / "cp"))
    citations, cited, _ = table_queries._session_tables(spark, SF)
    scope = sessions.export_scope(stored, cited.withColumn("session_id", F.col("session_id").cast("string")))
    want = table_queries.session_citations(spark, SF)
    assert {(r.session_id, r["index"], r.chunk_id) for r in scope.collect()} == {(str(r.session_id), r["index"], r.chunk_id) for r in want.collect()}


def test_expired_session_is_gone(spark, tmp_path, request):
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(setting, "false")
    request.addfinalizer(lambda: spark.conf.unset(setting))
    source = str(tmp_path / "events")

    def send(*rows):
        spark.createDataFrame(rows, session_stream.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run(lifetime):
        events = spark.readStream.schema(session_stream.EVENTS).parquet(source)
        query = (session_stream.gate_updates(events, lifetime).writeStream.outputMode("update")
                 .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "out")))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        return {r.session_id: r for r in spark.read.schema(session_stream.GATE).parquet(str(tmp_path / "out")).collect()}

    send(("old", "citation", 1, "a"), ("old", "verify", None, "a"), ("kept", "citation", 1, "k"))
    assert run(1)["old"].allowed
    time.sleep(0.2)
    send(("kept", "citation", 2, "l"), ("new", "citation", 1, "n"))
    run(3_600_000)
    live = {r.session_id for r in session_stream.stored_citations(spark, str(tmp_path / "cp")).collect()}
    assert "old" not in live and "new" in live
    send(("old", "cited", 1, None), ("new", "verify", None, "n"))
    got = run(3_600_000)
    assert got["old"].total == 0 and not got["old"].allowed and got["new"].allowed


def test_audit_stream_appends_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(NOW, "e", None, {"k": "v"})], schemas.LOG).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(schemas.LOG).parquet(source)
        audit_stream.start_append(stream, target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 1


def test_pages_per_task_do_not_grow_with_the_table(spark, monkeypatch):
    pages = spark.range(400).selectExpr("id", "concat('<p>Text <b>', id, '</b></p>') as html")
    few = {r["id"]: r["text"] for r in html.text_pages(pages, ["id"]).selectExpr("id", "pages[0].text as text").collect()}
    monkeypatch.setattr(html, "TASK_PAGES", 5)
    tokens = html.elements(pages, ["id"])
    per_task = tokens.groupBy(F.spark_partition_id()).agg(F.countDistinct("id").alias("n")).collect()
    assert len(per_task) > 60 and max(r["n"] for r in per_task) <= 20
    assert few == {r["id"]: r["text"] for r in html.text_pages(pages, ["id"]).selectExpr("id", "pages[0].text as text").collect()}

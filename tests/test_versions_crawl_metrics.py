"""Versioned tables, link crawl, run counters and open log fields."""

import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog as cat
from docloom.operators import crawl, merge
from docloom.plans import metrics
from docloom.sources import snapshots, variant_log

# ---- versioned tables ----


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, name string")


def content(frame):
    return sorted((r["id"], r["name"]) for r in frame.collect())


def test_versions_stay_readable(spark, tmp_path):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"), ("id",))
    assert table.version() == -1
    assert table.append(rows_of(spark, [(1, "a"), (2, "b")])) == 0
    assert table.append(rows_of(spark, [(3, "c")])) == 1
    assert table.merge(rows_of(spark, [(2, "B"), (4, "d"), (4, "D")]), "id") == 2
    assert table.overwrite(table.read().where("id > 2")) == 3
    assert content(table.read(0)) == [(1, "a"), (2, "b")] and content(table.read(1)) == [(1, "a"), (2, "b"), (3, "c")]
    assert content(table.read(2)) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert content(table.read()) == [(3, "c"), (4, "d")]
    assert [r["operation"] for r in table.history().orderBy("version").collect()] == ["append", "append", "merge", "overwrite"]
    with pytest.raises(ValueError):
        table.read(9)


def test_a_write_that_fails_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"), ("id",))
    table.append(rows_of(spark, [(1, "a")]))

    def fails(*args):
        raise OSError("lost between write and commit")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots.VersionedTable, "_commit", fails)
        for write in (lambda: table.append(rows_of(spark, [(2, "b")])), lambda: table.overwrite(rows_of(spark, [(9, "z")])), lambda: table.merge(rows_of(spark, [(1, "A")]), "id")):
            with pytest.raises(OSError):
                write()
    assert table.version() == 0 and content(table.read()) == [(1, "a")]
    assert table.append(rows_of(spark, [(3, "c")])) == 1 and content(table.read()) == [(1, "a"), (3, "c")]


def test_concurrent_writers(spark, tmp_path, monkeypatch):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"), ("id",))
    table.append(rows_of(spark, [(1, "a")]))
    table.append(rows_of(spark, [(5, "e")]))
    written, others = snapshots.VersionedTable._written, []

    def interrupted(self, rows):
        out = written(self, rows)
        if others:
            others.pop()()
        return out

    monkeypatch.setattr(snapshots.VersionedTable, "_written", interrupted)
    # Another append comes first: this one takes the next number.
    others.append(lambda: table.append(rows_of(spark, [(2, "b")])))
    assert table.append(rows_of(spark, [(3, "c")])) == 3
    # A merge of other files comes first: nothing is lost.
    others.append(lambda: table.merge(rows_of(spark, [(5, "E")]), "id"))
    assert table.merge(rows_of(spark, [(1, "A")]), "id") == 5
    assert content(table.read()) == [(1, "A"), (2, "b"), (3, "c"), (5, "E")]
    # One of the same file: this write read rows that are gone, and says so.
    others.append(lambda: table.merge(rows_of(spark, [(1, "first")]), "id"))
    with pytest.raises(snapshots.ConcurrentChange):
        table.merge(rows_of(spark, [(1, "second")]), "id")
    others.append(lambda: table.append(rows_of(spark, [(7, "g")])))
    with pytest.raises(snapshots.ConcurrentChange):
        table.overwrite(rows_of(spark, [(0, "all")]))
    assert content(table.read()) == [(1, "first"), (2, "b"), (3, "c"), (5, "E"), (7, "g")]


def test_ranges_skip_files(spark, tmp_path):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"), ("id", "name"))
    for start in (0, 100, 200):
        table.append(rows_of(spark, [(start + k, f"n{start + k:03d}") for k in range(10)]).coalesce(1))
    table.append(rows_of(spark, [(None, None)]).coalesce(1))
    got = table.read(between={"id": (105, 200)})
    assert content(got) == [(k, f"n{k:03d}") for k in (105, 106, 107, 108, 109, 200)] and len(got.inputFiles()) == 2
    assert len(table.read(between={"name": ("n200", None)}).inputFiles()) == 1
    assert table.read(between={"id": (50, 60)}).count() == 0 and table.read().count() == 31
    with pytest.raises(ValueError):
        table.read(between={"other": (1, 2)})


def test_rows_without_a_key_and_unused_files(spark, tmp_path):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"), ("id",))
    table.merge(rows_of(spark, [(None, "x"), (None, "x"), (1, "a"), (1, "b")]), "id")
    assert sorted((r["id"] is None, r["name"]) for r in table.read().collect()) == [(False, "b"), (True, "x"), (True, "x")]
    table.overwrite(rows_of(spark, [(2, "c")]))
    assert table.delete_unused(0) == []
    gone = table.delete_unused(1)
    assert gone and content(table.read()) == [(2, "c")]
    with pytest.raises(Exception):
        table.read(0).collect()


# ---- crawl ----

LINKS = [
    ("https://h.org/a", ["/b", "/c", "x.pdf", "#top", "/pic.png", "https://other.org/z"]),
    ("https://h.org/b", ["/c", "/d", "/a", "/files/x.pdf", "mailto:x@h.org"]),
    ("https://h.org/c", ["/e?page=2", "/x.PDF", "//h.org/b"]),
    ("https://h.org/d", ["/f", "/x.pdf"]),
    ("https://h.org/e?page=2", ["?page=3", "/style.css"]),
    ("https://h.org/f", ["/a"]),
]


def pages_of(spark):
    html = lambda links: "<html>" + "".join(f"<A class='k' HREF=\"{h}\"> <b>{h}</b>\n title</a>" for h in links) + "</html>"
    return spark.createDataFrame([(u, html(ls)) for u, ls in LINKS] + [("https://h.org/none", None)], "url string, html string")


def plain_crawl(links, start, site, max_pages=None, max_pdfs=None, max_hops=None):
    """A queue over the same rows."""
    seen, pdfs, queue = {}, {}, deque()
    for url in start:
        if url not in seen and (max_pages is None or len(seen) < max_pages):
            seen[url] = 0
            queue.append(url)
    while queue:
        page = queue.popleft()
        for target, title in links.get(page, ()):
            if target.split("/")[2:3] != [site] or not target.lower().startswith("http"):
                continue
            if target.lower().endswith(".pdf"):
                pdfs.setdefault(target, (seen[page], title))
            elif not target.lower().endswith((".png", ".jpg", ".css", ".js")) and target not in seen:
                if (max_hops is None or seen[page] < max_hops) and (max_pages is None or len(seen) < max_pages):
                    seen[target] = seen[page] + 1
                    queue.append(target)
    return {(u, "page", h, None) for u, h in seen.items()} | {(u, "pdf", *v) for u, v in list(pdfs.items())[:max_pdfs]}


@pytest.mark.parametrize("limits", [{}, {"max_hops": 1}, {"max_hops": 0}, {"max_pages": 3}, {"max_pages": 1}, {"max_pages": 100, "max_pdfs": 2}])
def test_crawl_is_a_queue_over_links(spark, limits):
    links = crawl.page_links(pages_of(spark))
    start = spark.createDataFrame([("https://h.org/a",), (None,), ("https://h.org/a",)], "url string")
    own = {}
    for r in links.orderBy("page_url", "position").collect():
        own.setdefault(r["page_url"], []).append((r["target"], r["title"]))
    got = {tuple(r) for r in crawl.crawl(links, start, "https://h.org/", **limits).collect()}
    assert got == plain_crawl(own, ["https://h.org/a"], "h.org", **limits)


def test_page_links_resolve_addresses(spark):
    links = {(r["page_url"], r["position"]): (r["target"], r["title"]) for r in crawl.page_links(pages_of(spark)).collect()}
    assert links["https://h.org/a", 0] == ("https://h.org/b", "/b title") and links["https://h.org/a", 2][0] == "https://h.org/x.pdf"
    assert links["https://h.org/c", 2][0] == "https://h.org/b" and links["https://h.org/e?page=2", 0][0] == "https://h.org/e?page=3"
    assert ("https://h.org/a", 3) not in links and not any(u == "https://h.org/none" for u, _ in links)


def test_crawl_of_nothing(spark):
    links = crawl.page_links(pages_of(spark))
    nowhere = spark.createDataFrame([], "url string")
    assert crawl.crawl(links, nowhere, "https://h.org/").count() == 0
    alone = spark.createDataFrame([("https://h.org/unknown",)], "url string")
    assert [tuple(r) for r in crawl.crawl(links, alone, "https://h.org/").collect()] == [("https://h.org/unknown", "page", 0, None)]


# ---- counters ----

def test_counters_come_from_the_run_itself(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(outcome):
        calls.add(1)
        return outcome

    admitted = spark.createDataFrame([("ingested", 3), ("skipped_existing", 2), ("skipped_pii", 5), ("ingested", 1)], "outcome string, occurrences long")
    run = metrics.RunMetrics()
    counted = run.counted("admission", admitted.withColumn("outcome", seen("outcome")), **metrics.admission_counters())
    counted.write.parquet(str(tmp_path / "out"))
    assert run.values() == {"admission": {"ingested": 2, "skipped_existing": 4, "skipped_pii": 5}} and calls.value == 4
    assert run.values()["admission"] == cat.admission_counts(admitted).first().asDict()
    assert {(r["step"], r["counter"]): r["value"] for r in run.table(spark).collect()}["admission", "skipped_pii"] == 5.0
    with pytest.raises(ValueError):
        run.counted("admission", admitted, n=F.count("*"))


def test_stream_counters_sum_over_batches(spark, tmp_path):
    listener = metrics.StreamMetrics()
    spark.streams.addListener(listener)
    try:
        source = str(tmp_path / "in")
        for part in ([(1,), (2,)], [(3,)]):
            spark.createDataFrame(part, "n long").coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(source).observe("arrivals", F.count("*").alias("rows"), F.sum("n").alias("total"))
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.totals["arrivals"]["rows"] == 3:
                break
            time.sleep(0.1)
        assert dict(listener.totals["arrivals"]) == {"rows": 3, "total": 6} and len(listener.batches["arrivals"]) == 2
    finally:
        spark.streams.removeListener(listener)


# ---- logs ----

LINES = [
    '{"timestamp": "2026-06-01T00:00:00Z", "event": "pii_rejected", "source": "s", "violations": ["email", "phone"], "at": {"page": 3}}',
    '{"timestamp": "2026-06-02T00:00:00Z", "event": "download_skipped_large", "megabytes": 13.5}', '{"event": "pii_rejected", "violations": []}',
    "", "   ", "no json {", '{"event": "odd", "violations": "text", "megabytes": "1e1"}', '{"event": "pii_rejected", "violations": null}',
]


def test_open_fields_keep_their_types(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES) + "\n")
    log = variant_log.read_log(spark, str(tmp_path))
    rows = variant_log.with_fields(log, violations="array<string>", megabytes="double").collect()
    assert len(rows) == 6 and [r["broken"] for r in rows if r["broken"]] == ["no json {"]
    assert [(r["event"], r["violations"], r["megabytes"]) for r in rows] == [
        ("pii_rejected", ["email", "phone"], None), ("download_skipped_large", None, 13.5), ("pii_rejected", [], None), (None, None, None),
        ("odd", None, 10.0), ("pii_rejected", None, None)]
    assert log.select(variant_log.field(F.col("fields"), "at.page", "int").alias("p")).where("p = 3").count() == 1


def test_inventory_of_fields(spark):
    log = variant_log.parsed(spark.createDataFrame([(x,) for x in LINES], "value string"))
    log = log.withColumn("event", variant_log.field(F.col("fields"), "event"))
    got = {(r["event"], r["key"], r["type"]): r["n"] for r in variant_log.inventory(log).collect()}
    assert got["pii_rejected", "violations", "ARRAY<STRING>"] == 1 and got["pii_rejected", "violations", "VOID"] == 1
    assert got["odd", "megabytes", "STRING"] == 1 and got["pii_rejected", "event", "STRING"] == 3
    assert variant_log.inventory(log.limit(0)).count() == 0


# ---- keys ----

def test_rows_without_a_key_are_not_folded(spark):
    stored = spark.createDataFrame([(1, "a"), (None, "s")], "chunk_id long, v string")
    incoming = spark.createDataFrame([(None, "x"), (None, "x"), (None, "y"), (1, "b"), (1, "c"), (2, "d")], "chunk_id long, v string")
    got = sorted((r["chunk_id"] or 0, r["v"]) for r in merge.upsert(stored, incoming, order=[F.desc("v")]).collect())
    assert got == [(0, "s"), (0, "x"), (0, "x"), (0, "y"), (1, "c"), (2, "d")]
    picks = {tuple(sorted((r["chunk_id"] or 0, r["v"]) for r in merge.upsert(stored, incoming.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(picks) == 1


def test_a_crawl_derives_its_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"https://h/{n}", 0, f"https://h/{n + 1}", "t") for n in range(4)]
    table = spark.createDataFrame(rows, "page_url string, position int, target string, title string").coalesce(1)
    start = spark.createDataFrame([("https://h/0",)], "url string")
    got = crawl.crawl(table.mapInArrow(counted, table.schema), start, "https://h/")
    assert sorted((r["url"], r["hop"]) for r in got.collect()) == [(f"https://h/{n}", n) for n in range(5)]
    assert read.value == len(rows)

import itertools
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import structure, text
from docloom.operators import chunking

TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|[^\s\w]+|_")


def n_tokens(s):
    return len(TOKEN.findall(s))


def docs(spark, *pages):
    row = [(f"sha256:{'ab' * 8}", "Nature", "https://www.nature.com/articles/s1-2-3-4", "A long enough title",
            "2026-05-20", [(i + 1, p) for i, p in enumerate(pages)])]
    return spark.createDataFrame(
        row,
        "document_id string, source_org string, source_url string, document_title string, "
        "publication_date string, pages array<struct<page_number:int,text:string>>",
    )


def drafts(spark, *pages):
    made = chunking.with_drafts(chunking.with_units(chunking.with_sections(docs(spark, *pages))))
    return made.first()["drafts"]


SENTENCE = "The trial enrolled {} patients with severe asthma in three hospitals over two years."


def test_sections_cover_the_page(spark):
    page = "Lead line before any heading of the page.\n\nMETHODS\nWe measured the outcome carefully.\n# Results:\nIt worked as expected in all groups."
    rows = chunking.with_sections(docs(spark, page)).first()["sections"]
    assert [r.title for r in rows] == [None, "METHODS", "Results"]
    assert all(0 <= r.start_char < r.end_char <= len(page) for r in rows)
    assert [page[r.start_char:r.end_char].split("\n")[0] for r in rows] == [
        "Lead line before any heading of the page.", "METHODS", "# Results:",
    ]


def test_short_sections_merge_within_a_page(spark):
    page = "METHODS\nWe measured the outcome carefully.\nRESULTS\nok"
    rows = chunking.with_sections(docs(spark, page, "SUMMARY\nno")).first()["sections"]
    assert len(rows) == 2 and rows[0].text.endswith("RESULTS\n\nok")
    assert rows[1].page_number == 2  # never merged into another page


def test_heading_without_body_uses_its_title(spark):
    rows = chunking.with_sections(docs(spark, "EXECUTIVE SUMMARY OF THE TRIAL")).first()["sections"]
    assert rows[0].text == "EXECUTIVE SUMMARY OF THE TRIAL"


def test_units_stay_in_their_section_and_budget(spark):
    page = "METHODS\n" + " ".join(SENTENCE.format(i) for i in range(60)) + "\nRESULTS\n" + SENTENCE.format(999)
    made = chunking.with_units(chunking.with_sections(docs(spark, page))).first()["units"]
    assert len(made) >= 3 and made[-1].section_title == "RESULTS"
    assert all(u.token_count <= 400 for u in made)


@pytest.mark.parametrize("n_sentences", [1, 40, 200])
def test_chunks_respect_the_cap_and_overlap(spark, n_sentences):
    got = drafts(spark, " ".join(SENTENCE.format(i) for i in range(n_sentences)))
    assert all(d.token_count <= 512 and d.token_count == n_tokens(d.exact_context) for d in got)
    for before, after in zip(got, got[1:]):
        tail = TOKEN.findall(before.exact_context)[-80:]
        assert TOKEN.findall(after.exact_context)[:len(tail)] == tail


def test_no_text_is_lost(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    page = " ".join(words[:1500]) + ". " + " ".join(words[1500:]) + "."
    got = drafts(spark, page)
    assert all(d.token_count <= 512 for d in got)
    seen, position = [], 0
    for d in got:
        toks = TOKEN.findall(d.exact_context)
        seen += toks[min(80, position):]
        position += len(toks) - min(80, position)
    assert [t for t in seen if t != "."] == words


def test_overlap_reaches_back_over_short_chunks(spark):
    pages = [f"TOPIC NUMBER {w}\nShort body text {w} of this little section here." for w in ("ONE", "TWO", "SIX")]
    got = drafts(spark, "\n".join(pages))
    assert len(got) == 3
    assert got[2].exact_context.startswith("Short body text ONE")


def test_chunk_numbers_restart_per_page(spark):
    long = " ".join(SENTENCE.format(i) for i in range(40))
    rows = chunking.chunk_records(docs(spark, long, SENTENCE.format(1)), "2026-06-01T00:00:00Z").collect()
    ids = [(r.page_number, r.chunk_index) for r in rows]
    assert ids == [(1, 1), (1, 2), (2, 1)]
    assert rows[0].chunk_id == f"sha256:{'ab' * 8}::p0001::c0001"
    again = chunking.chunk_records(docs(spark, long, SENTENCE.format(1)), "2026-06-01T00:00:00Z").collect()
    assert rows == again


def test_noise_leaves_gaps_in_the_numbering(spark):
    page = "METHODS\nmock ingest content for the first part.\nRESULTS\n" + SENTENCE.format(3)
    first = chunking.with_drafts(chunking.with_units(chunking.with_sections(docs(spark, page))))
    assert len(first.first()["drafts"]) == 2
    # The placeholder text repeats in the overlap of the second chunk, so both go.
    assert chunking.chunk_records(docs(spark, page), "t").count() == 0


def test_pii_report_flags_documents(spark):
    rows = spark.createDataFrame(
        [("d1", "mail a@b.org"), ("d1", "clean"), ("d2", "clean"), ("d2", "also"), ("d2", "x"), ("d2", "a@b.org")],
        "document_id string, exact_context string",
    )
    got = {r.document_id: (r.dropped, r.total, r.review) for r in chunking.pii_report(rows).collect()}
    assert got == {"d1": (1, 2, True), "d2": (1, 4, False)}
    assert chunking.drop_pii_chunks(rows).count() == 4


def test_token_windows_rebuild_the_text(value):
    s = "one two  three, four\nfive 123456 sévère—x"
    assert "".join(value(structure.token_windows(F.lit(s), 3))) == s
    assert value(text.count_tokens(F.lit(s))) == len(value(text.tokens(F.lit(s))))


def test_batches(value):
    lengths = F.array(*[F.lit(n) for n in (10, 10, 10, 200, 10, 50, 50, 10)])
    assert value(structure.batch_starts(lengths, 2, 100)) == [0, 2, 3, 4, 6]


def test_running_totals(spark):
    rows = [(n, [(i * 37) % 11 for i in range(n)]) for n in (0, 1, 63, 64, 65, 4096, 4097, 300_000)]
    frame = spark.createDataFrame(rows, "n int, counts array<int>")
    for r in frame.select("counts", structure.running_totals(F.col("counts")).alias("before")).collect():
        assert r.before == list(itertools.accumulate(r.counts, initial=0))[:-1]


def test_trimmed_equals_strip_and_breaks_survive_the_mark(spark, value):
    """Long text is not read to be trimmed, sentences are split by a mark: both as before on odd characters."""
    ends = ["", "!", "~", "\x7f", "\x00", "\x1b", "\u00e9", "\u200b", "\U0001f600", *text.fv.WHITESPACE]
    rows = [(a + body + b,) for a in ends for b in ends for body in ("x y", "")] + [(None,)]
    got = spark.createDataFrame(rows, "t string").select(text.trimmed(F.col("t")).alias("a"), text.strip(F.col("t")).alias("b"))
    assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    plain = "One ends. Two, Fig. 3 stays! Three\u2003four?  Five."
    assert value(text.split_sentences(F.lit(plain))) == ["One ends.", "Two, Fig. 3 stays!", "Three\u2003four?", "Five."]
    assert value(text.split_sentences(F.lit("A\x02b. Cd\x02. E"))) == ["A\x02b.", "Cd\x02.", "E"]


def test_headings_are_tried_at_the_start_of_a_line_only(spark, value):
    assert structure._MARKED.startswith("(?U)^") and "|^" not in structure._MARKED
    for line, head in (("x # no", False), ("# yes", True), ("see 2.1 Findings", False), ("2.1 Findings:", True),
                       ("RESULTS::", True), ("Methods", True), ("M" * 81, False), ("ONE TWO " * 9, True), ("ONE TWO " * 11, False)):
        assert value(structure.is_heading(F.lit(line))) is head, line

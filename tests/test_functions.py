import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import dates, identity, intent, quality, render, structure, text, urls, vectors


@pytest.mark.parametrize(
    "label,sample",
    [
        ("aadhaar", "id 1234 5678 9012 ok"), ("aadhaar", "1234-5678-9012"), ("pan", "ABCDE1234F"),
        ("phone", "call +91 9876543210"), ("email", "write to a.b@mail.org now"),
        ("credential", "api_key = abc"), ("credential", "password: x"),
    ],
)
def test_pii_is_found(value, label, sample):
    assert label in value(quality.pii_violations(F.lit(sample)))


@pytest.mark.parametrize("sample", ["dose 12 mg twice", "12345", "no mail at example dot org"])
def test_clean_text_passes(value, sample):
    assert value(quality.is_clean(F.lit(sample)))


def test_reject_fails_on_pii(spark):
    with pytest.raises(Exception, match="PII detected: email"):
        spark.range(1).select(quality.reject_if_pii(F.lit("a@b.org"))).collect()


def test_long_digit_run_is_a_phone(value):
    assert value(quality.pii_violations(F.lit("1119876543210")))  # no left boundary


@pytest.mark.parametrize(
    "line,expected",
    [
        ("# Background", True), ("1. Background", True), ("2.3 Treatment Protocol", True),
        ("Contraindications:", True), ("executive summary", True), ("TREATMENT GUIDELINES 2026", True),
        ("The patient was treated.", False), ("", False), ("ABC", False), ("dosage of the drug", False),
    ],
)
def test_heading(value, line, expected):
    assert value(structure.is_heading(F.lit(line))) is expected


def test_normalisation(value):
    raw = "a   b\r\nc\x00d  \r é"
    assert value(text.normalize_page_text(F.lit(raw))) == "a b\ncd\né"


def test_abbreviations_do_not_split(value):
    got = value(text.split_sentences(F.lit("Dr. Smith came, e.g. today. He left. The piano. Mrs. X sang.")))
    assert got == ["Dr. Smith came, e.g. today.", "He left.", "The piano.", "Mrs. X sang."]


def test_sanitise_keeps_prose(value):
    page = (
        "Share this article\nAbstract text about treatment that matters.\nKeywords: a, b\n"
        "/s41467-026-73798-3\nReferences\n\nSecond paragraph."
    )
    assert value(text.sanitize(F.lit(page))) == "Abstract text about treatment that matters.\n\nSecond paragraph."


def test_sanitise_falls_back_to_inline_removal(value):
    assert value(text.sanitize(F.lit("Keywords: a, b. Real text here."))) == "Real text here."


def test_titles(value):
    low = quality.is_low_quality_title
    assert value(low(F.lit("(1.2 MB)"))) and value(low(F.lit("short"))) and value(low(F.lit("Guidelines")))
    got = quality.resolve_title(F.lit("x"), F.lit("https://a.org"), F.lit("12\nA line that is long enough to use"))
    assert value(got) == "A line that is long enough to use"
    legacy = quality.resolve_title(F.lit(""), F.lit("https://htain.dhr.gov.in/x"), F.lit(""))
    assert value(legacy).startswith("Legacy")


def test_ids(value):
    assert value(identity.chunk_id(F.lit("sha256:4942ed487933e004"), F.lit(24), F.lit(3))) == (
        "sha256:4942ed487933e004::p0024::c0003"
    )
    assert value(identity.document_of_chunk(F.lit("a::p1::c2"))) == "a"
    assert value(identity.document_of_chunk(F.lit("plain"))) == "plain"
    import hashlib

    want = "sha256:" + hashlib.sha256(b"http://x|title").hexdigest()[:16]
    assert value(identity.document_id(F.lit(" HTTP://X "), F.lit("Title "))) == want
    both = hashlib.sha256(b"a\nb").hexdigest()[:16]
    assert value(identity.combined_hash(F.array(F.lit("b"), F.lit("a")))) == f"sha256:{both}"


@pytest.mark.parametrize(
    "question,expected",
    [
        ("on 2026-06-01 please", datetime.date(2026, 6, 1)), ("on 1 June 2026", datetime.date(2026, 6, 1)),
        ("June 1, 2026", datetime.date(2026, 6, 1)), ("2026-13-40", None), ("no date", None),
    ],
)
def test_question_dates(value, question, expected):
    assert value(dates.question_date(F.lit(question))) == expected


def test_question_analysis(spark):
    rows = spark.createDataFrame(
        [
            ("how many reports have been published on nature on 1 june 2026",),
            ("How much pizza can a 2 year old kid eat in nature",),
            ("quantum computing qubits in health",),
            ("bedaquiline resistant tuberculosis treatment",),
            ("Which articles about asthma",),
            ("Explain the results",),
        ],
        "question string",
    )
    got = {r.question[:10]: r for r in intent.analyze(rows).collect()}
    first = got["how many r"]
    assert (first.intent, first.source_org, first.enumeration) == ("count", "Nature", True)
    assert first.target_date == datetime.date(2026, 6, 1) and first.in_scope
    assert not got["How much p"].in_scope
    assert not got["quantum co"].in_scope
    assert got["bedaquilin"].in_scope and got["bedaquilin"].intent == "general"
    assert got["Which arti"].intent == "list" and got["Which arti"].multi_article
    assert got["Explain th"].intent == "explain" and not got["Explain th"].in_scope


def test_overlap_share(value):
    terms = text.gate_terms(F.lit("bedaquiline resistant tuberculosis treatment"))
    assert value(text.overlap_share(terms, F.lit("Tuberculosis treatments with bedaquiline"))) == 0.75
    assert value(text.overlap_share(text.gate_terms(F.lit("a b")), F.lit("x"))) == 0.0


def test_single_citation(value):
    got = value(render.single_citation(F.lit("**Summary:** A [1] and B [2]\n- c [3]")))
    assert got == "**Summary:** A  and B [1]\n- c"
    assert value(render.single_citation(F.lit("only [1]"))) == "only [1]"


def test_refusals(value):
    cited = render.cited_indices
    assert value(quality.refuses(F.lit("It does not contain that [1]"), cited(F.lit("[1]"))))
    assert value(quality.refuses(F.lit("Fine but uncited"), cited(F.lit(""))))
    assert not value(quality.refuses(F.lit("Fine [1]"), cited(F.lit("[1]"))))


def test_vectors(value, spark):
    assert value(vectors.l2_norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
    unit = value(vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))))
    assert unit == pytest.approx([0.6, 0.8, 0.0])
    assert not value(vectors.is_unit(F.array(F.lit(2.0), F.lit(0.0))))
    with pytest.raises(Exception, match="zero vector"):
        spark.range(1).select(vectors.l2_normalize(F.array(F.lit(0.0)))).collect()


def test_digest_vectors_differ_by_prefix(value):
    encode = vectors.digest_encoder(40)
    a = value(encode(vectors.passage_input(F.lit("text"))))
    b = value(encode(vectors.query_input(F.lit("text"))))
    assert len(a) == 40 and a != b
    assert value(vectors.passage_input(F.lit(" passage: x"))) == "passage: x"


def test_links(value, spark):
    listing = "https://h.org/s?article_type=research&subject=medical-research&date_range=last_30_days"
    assert value(urls.policy_violation(F.lit(listing))) is None
    assert value(urls.policy_violation(F.lit("https://h.org/s?x=1"))) == "date_range"
    assert value(urls.page_url(F.lit(listing), F.lit(3))) == listing + "&page=3"
    assert value(urls.page_url(F.lit("https://h.org/s?page=2&a=b"), F.lit(1))) == "https://h.org/s?a=b"
    assert value(urls.content_type(F.lit("https://h.org/A.PDF?x=1"))) == "pdf"
    old = "https://www.nature.com/articles/d41586-026-00001-0"
    assert value(urls.resolve_source_url(F.lit(f" {old} "))).endswith("s41467-026-73798-3")
    with pytest.raises(Exception, match="listing URL must set"):
        spark.range(1).select(urls.require_policy(F.lit("https://h.org/"))).collect()


def test_follow_up(value):
    assert value(text.is_follow_up(F.lit("asthma screening methods"), F.lit("Which asthma screening works")))
    assert not value(text.is_follow_up(F.lit("cats"), F.lit("asthma screening")))


def test_text_fragment(value):
    excerpt = "Short one. The asthma screening trial enrolled many patients in three large hospitals. End."
    got = value(text.text_fragment(F.lit(excerpt), F.lit("asthma screening trial")))
    assert got == "#:~:text=The%20asthma%20screening%20trial%20enrolled%20many,many%20patients%20in%20three%20large%20hospitals."


def test_markdown(value):
    raw = "## Results:\nsummary: ok\n* one\n1) two\nKey Points\n*Limits:**\n**Bold:** x"
    assert value(render.normalized_markdown(F.lit(raw))).split("\n") == [
        "**Results:**", "**Summary:** ok", "- one", "- two", "**Key Points:**", "**Limits:**", "**Bold:** x",
    ]


def test_personal_data_tests_agree_with_the_plain_patterns(spark):
    """Cheap tests in front of a pattern lose none of its matches, in any script or case."""
    from docloom.functions import fixed_values as fv, quality

    pieces = ["1234 5678-9012", "\u0661\u0662\u0663\u0664 \u0665\u0666\u0667\u0668 1234", "abcde1234f", "ABCDE123F", "+91 9876543210", "9876543210x", "x6876543210",
              "a.b@c.org", "Pa\u017fsword: x", "API-KEY = y", "secret_key:z", "passwd :", "\u017fecret-\u212aey=1", "+91", "1234", "plain words"]
    rows = [(a + joint + b,) for a in pieces for b in pieces for joint in (" ", "", "\n")] + [(None,), ("",)]
    plain = F.array_compact(F.array(*[
        F.when(F.col("t").rlike(("(?iU)" if fold else "(?U)") + pattern), F.lit(label)) for label, pattern, fold in fv.PII_PATTERNS]))
    got = spark.createDataFrame(rows, "t string").select("t", quality.pii_violations(F.col("t")).alias("a"), plain.alias("b"))
    assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    assert quality._NUMBERS and got.filter(F.size("a") > 0).count() > 100

"""Personal data, benchmark windows and the pipeline against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontam, pii, queries
from test_shingle_sets import plain_heads

SF = "/root/testdata/sf0.001"
CLASHING = ("row", "text_key", "found", "tried", "done", "many", "n_words", "hamming", "words", "score", "fp")
KEY = "k"


def frame(spark, texts):
    rows = [(None if k == 1 else k // 2, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def test_surrogates_keep_type_format_and_identity(spark):
    texts = [
        "Mail Max.Muster@mail7.example.com or max.muster@MAIL7.example.com, not eva@mail7.example.com.",
        "+1 (017) 555-7713 is +1 017 555 7713; card 4539578763621486, also 4539-5787-6362-1486.",
        "Host 192.168.7.1, not 1.2.3.4.5 or v300.1.1.1; ssn 123-45-6789.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f9aa" sk-ABCDEFGHIJKLMNOP1234',
        "Frau Anna Schmidt and Herr Schmidt met Mrs. Anna Schmidt; Господин Иван Петров.",
        None, "", "nothing here 12 34", "x" * 50_000, "Frau Anna Schmidt again, " * 500,
    ]
    docs = frame(spark, texts)
    out = pii.pseudonymize(docs, KEY, count_col="n")
    assert out.columns == [*docs.columns, "n"]
    rows = out.collect()
    assert len(rows) == len(texts)
    by = lambda mark: next(r for r in rows if r["text"] and mark in r["text"])
    mail = re.findall(r"\S+@\S+\.\w+", by("Mail ")["text"])
    assert mail[0].lower() == mail[1].lower() != mail[2].lower() and by("Mail ")["n"] == 3
    assert mail[0][0].isupper() and mail[0].split("@")[1].lower() == mail[2].split("@")[1].lower() and mail[0].endswith(".com") and "muster" not in mail[0].lower()
    phone = by(" is +")["text"]
    first, second = re.findall(r"\+1[ \d()-]+\d", phone)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", first) and re.sub(r"\D", "", first) == re.sub(r"\D", "", second) != "10175557713"
    cards = re.findall(r"card (\d{16}), also ([\d-]{19})", phone)[0]
    assert cards[0] == cards[1].replace("-", "") != "4539578763621486" and luhn(cards[0]) == luhn("4539578763621486") == 0
    host = by("Host")["text"]
    assert "192.168.7.1" not in host and "1.2.3.4.5" in host and "v300.1.1.1" in host and "123-45-6789" not in host and re.search(r"ssn \d{3}-\d{2}-\d{4}\.", host)
    key = by("token")["text"]
    assert re.search(r'"[0-9a-f]{40}" sk-[A-Z]{16}\d{4}$', key) and "04dbebab" not in key
    names = by("met")["text"]
    found = re.match(r"Frau (\w+) (\w+) and Herr (\w+) met Mrs\. (\w+) (\w+); Господин (\w+) ([а-яА-Я]+)\.$", names).groups()
    assert found[0] == found[3] in pii.GIVEN["f"] and found[1] == found[4] == found[2] != "Schmidt" and found[5] in pii.GIVEN_CYRILLIC["m"]
    assert sum(r["n"] for r in rows) == 3 + 4 + 2 + 2 + 4 + 500
    assert Counter(r["text"] for r in rows)[None] == 1 and "x" * 50_000 in {r["text"] for r in rows} and "nothing here 12 34" in {r["text"] for r in rows}
    assert {r["text"] for r in rows} == {r["text"] for r in pii.pseudonymize(docs, KEY).collect()} != {r["text"] for r in pii.pseudonymize(docs, "other").collect()}
    assert pii.pseudonymize(docs.limit(0), KEY).count() == 0


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    plain = pii.surrogate

    def narrow(key, kind, canon, attempt):
        # At first all share three values, one of them a real entity of the corpus.
        few = F.concat(F.lit("a"), F.abs(F.hash(canon)) % 3, F.lit("@b.com"))
        return F.when(attempt < 2, few).otherwise(plain(key, kind, canon, attempt))

    monkeypatch.setattr(pii, "surrogate", narrow)
    docs = frame(spark, [f"write to u{k}@b.com" for k in range(40)] + ["a1@b.com u3@b.com"])
    out = pii.pseudonymize(docs, KEY).collect()
    mails = [m for r in out for m in re.findall(r"\S+@\S+", r["text"])]
    assert len(mails) == 42 and len(set(mails)) == 41 and not {f"u{k}@b.com" for k in range(40)} & set(mails) and "a1@b.com" not in mails


def plain_similarity(a, b):
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_windows_against_brute_force(spark):
    words = [f"w{k}" for k in range(60)]
    item, short = " ".join(words), "tiny item here"
    changed = words.copy()
    changed[30] = "other"
    texts = [
        "before it " + item.upper() + " after it", " ".join(changed), " ".join(words[:50]), " ".join(words[:35]) + " cut", "x " * 3000 + item, "a tiny ITEM here b",
        None, "", "w1", "clean text with nothing of it " * 30, item + " and " + item, item,
    ]
    docs = frame(spark, texts)
    benchmark = spark.createDataFrame([(1, item), (2, item), (None, short), (4, None), (5, "  ")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item"], round(r["similarity"], 9)) for r in decontam.leaks(docs, benchmark).collect())
    expected = Counter()
    for r in docs.collect():
        own = (r["text"] or "").lower().split()
        for number, text in ((1, item), (2, item), (None, short)):
            size = len(text.split())
            best = max((plain_similarity(own[k:k + size], text.split()) for k in range(max(1, len(own) - size + 1))), default=0) if own else 0
            if best >= 0.8:
                expected[r["doc_id"], number, round(best, 9)] += 1
    assert got == expected and sum(got.values()) >= 9
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(1 for t in texts if t in (None, "", "w1") or "clean" in t or "cut" in t)
    monkey = decontam.BROADCAST_ANCHORS
    try:
        decontam.BROADCAST_ANCHORS = 0  # the way of a large benchmark
        assert Counter((r["doc_id"], r["item"], round(r["similarity"], 9)) for r in decontam.leaks(docs, benchmark).collect()) == expected
    finally:
        decontam.BROADCAST_ANCHORS = monkey
    for a, b in ((docs.limit(0), benchmark), (docs, benchmark.limit(0))):
        assert decontam.leaks(a, b).count() == 0 and decontam.decontaminate(a, b).count() == a.count()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((before, docs))
    return out


def test_stages_filter_what_the_one_before_kept(spark, stages):
    columns = queries.table(spark, SF, "documents").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    toxic, near, clean, private, packed = stages
    scored = queries.op2_toxicity(spark, SF).where("predicted = 0").select("doc_id")
    assert {r[0] for r in toxic[1].select("doc_id").collect()} == {r[0] for r in scored.collect()}
    # Five-word sets of similarity 0.8 or more, all pairs compared.
    heads = plain_heads([(r["doc_id"], r["text"]) for r in near[0].collect()])
    assert Counter(r[0] for r in near[1].select("doc_id").collect()) == heads
    leaked = {r["doc_id"] for r in decontam.leaks(clean[0], queries.table(spark, SF, "benchmark")).collect()}
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(clean[1]) == ids(clean[0]) - leaked and ids(private[1]) == ids(private[0])
    found = re.compile(r"\d{16}|@mail\d")
    assert not any(found.search(a["text"]) and found.findall(a["text"]) == found.findall(b["text"]) for a, b in zip(
        private[0].orderBy("doc_id").collect(), private[1].orderBy("doc_id").collect()))
    tokens = packed[1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert ids(tokens) == ids(private[1]) and tokens.where("n != t").count() == 0


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids")
    assert rows.exceptAll(stages[-1][1].select(*rows.columns)).count() == 0 and rows.count() == stages[-1][1].count()

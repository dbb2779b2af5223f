"""Phrase mining, multiset hashes and lexical search against plain recomputation."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import lexical_rank, multiset_hash, phrases

DOCS = "doc_id long, text string, lang string, score double, item string, w1 long, id long, `_range` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, "x", 7, 8, 9) for i, t, g in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# ---- phrases ----

def plain_phrases(rows, top, least, share):
    words, grams = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            own = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    grams[lang, tuple(own[i:i + k])] += 1
            words[lang] += len(own)
    found = []
    for (lang, g), a in grams.items():
        if len(g) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        longer = [f for (o, h), f in grams.items() if o == lang and len(h) == 3 and f >= least and len(g) == 2 and g in (h[:2], h[1:])]
        if not any(100 * f >= share * a for f in longer):
            found.append((lang, " ".join(g), a, grams[lang, g[:k]], grams[lang, g[k:]], words[lang], score))
    out = []
    for lang in {f[0] for f in found}:
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        out += [(f[0], n, *f[1:]) for n, f in enumerate(own[:top], 1)]
    return sorted(out)


PHRASES = [
    (1, "New York is big. New York, new york! NEW york city city city", "en"),
    (2, "in new york city\tin new york city\nin new york", "en"),
    (2, "in new york city\tin new york city\nin new york", "en"),
    (3, None, "en"), (4, "", None), (5, "a a a a a a a ÄÖ äö äö", None), (6, " ;;. ", "de"),
    (7, "und und und so so so und so", "und"), (8, "x\x00y z x\x00y z\x0bx\x00y z", "fr"), (None, "new york", "en"),
]


@pytest.mark.parametrize("top, least, share", [(2000, 2, 50), (3, 2, 50), (2000, 3, 101), (5, 1, 10)])
def test_phrases_equal_a_plain_count(spark, top, least, share):
    got = phrases.collocations(docs_of(spark, PHRASES).repartition(3), top, least, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(PHRASES, top, least, share)


def test_phrases_over_many_shards(spark, monkeypatch):
    """Counts are those of the whole, however texts are cut into shards; a word per shard row too."""
    rows = [(k, f"alpha beta w{k % 4}. gamma delta alpha beta; w{k % 3} " * 5, "en") for k in range(60)]
    monkeypatch.setattr(phrases, "SHARD_BYTES", 64)
    assert list(phrases._cut(b"ab\ncd\n" * 20))[0].endswith(b"\n")
    docs = docs_of(spark, rows).coalesce(2)
    assert sorted(map(tuple, phrases.collocations(docs, 50, 5).collect())) == plain_phrases(rows, 50, 5, 50)


def test_shard_intervals_count_every_window():
    shard = phrases.Shard([b"a b a b a\nb a b", b"", b"c", b"a b a"])
    got = Counter()
    for one, two, three, size, pair in shard.intervals():
        word = lambda i: shard.words[i - 1].decode() if i else ""
        for o, t, h, n in zip(one, two, three, size):
            if o and t:
                got[word(o), word(t), word(h)] += int(n)
    want = Counter()
    for piece in ("a b a b a", "b a b", "c", "a b a"):
        own = [*piece.split(), ""]
        want.update(tuple(own[i:i + 3]) for i in range(len(own) - 2))
    assert {k: v for k, v in got.items() if k[2]} == {k: v for k, v in want.items() if k[2]}
    # With ends, the windows of a pair add up to the pair.
    pairs = Counter()
    for (a, b, _), n in got.items():
        pairs[a, b] += n
    assert pairs == Counter({("a", "b"): 4, ("b", "a"): 4})


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "one two three", "en")])).count() == 0


def test_phrase_scores_past_64_bits(spark):
    one = spark.range(1).select(phrases._score(F.lit(10**12), F.lit(3 * 10**12), F.lit(7 * 10**12)).alias("s"))
    assert one.first()["s"] == 1_000_000 * 10**24 // (21 * 10**24)


# ---- fingerprints ----

def plain_lanes(text):
    def hexes(parts):
        return [hashlib.sha256(p.encode()).hexdigest() for p in parts if p]

    paragraphs, sentences = hexes((text or "").split("\n")), hexes(re.split("[.!?\n]", text or ""))
    strong = [sum(int(h[8 * k:8 * k + 8], 16) for h in paragraphs) % 2**32 for k in range(8)]
    like = [sum(2 * (int(h[8 * k:8 * k + 8], 16) >> p & 1) - 1 for h in sentences) % 2**16 for k in range(8) for p in range(32)]
    return strong, like


def plain_text_of(text):
    strong, like = plain_lanes(text)
    return "".join(f"{x:08x}" for x in strong) + "".join(f"{x:04x}" for x in like)


def plain_likeness(a, b):
    if plain_text_of(a) == plain_text_of(b):
        return 1.0
    x, y = ([v - 65536 if v >= 32768 else v for v in plain_lanes(t)[1]] for t in (a, b))
    sizes = sum(v * v for v in x) + sum(v * v for v in y)
    return min(1.0, max(0.0, 2 * sum(map(lambda p, q: p * q, x, y)) / sizes)) if sizes else 0.0


TEXTS = [
    (5, "One. Two! Three?\nFour. Five six seven. Eight\n\nNine", "en"), (9, "Four. Five six seven. Eight\n\nNine\nOne. Two! Three?", "en"),
    (3, None, "en"), (2, "", "en"), (7, "x", "de"), (6, "One. Two! Three?\nFour. Five six seven. Eight\n\nNine", "en"),
    (-4, "äöü ß. 𝒳𝒴 long " * 30, None), (1 << 60, "same line\n" * 40, "en"), (4, "a.b", "en"),
]


def test_fingerprints_equal_a_plain_sum(spark):
    got = multiset_hash.compare_with_next(docs_of(spark, TEXTS).repartition(3)).select(
        "doc_id", "text", "n_chars", "edited", multiset_hash.text_of(F.col("own")), multiset_hash.text_of(F.col("edited_own")), "near_edited", "near_next").collect()
    order = sorted(TEXTS, key=lambda r: -r[0])
    want = {}
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want[i] = (i, text, len(text), edited, plain_text_of(text), plain_text_of(edited), plain_likeness(text, edited), plain_likeness(text, after))
    assert {r[0]: tuple(r) for r in got} == want


def test_paragraph_order_does_not_matter(spark):
    a, b = "p one.\np two. x\np three", "p three\np one.\np two. x"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        multiset_hash.lanes(F.col("a")).alias("a"), multiset_hash.lanes(F.col("b")).alias("b"))
    assert row.where("a = b").count() == 1


def test_insertion_and_deletion_read_no_text(spark):
    frame = spark.createDataFrame([("p one.\np two. x", "added. line\np one.", "p one.\np two. x\nadded. line\np one.")], "a string, b string, c string")
    h = frame.select(*(multiset_hash.lanes(F.col(c)).alias(c) for c in "abc"))
    both = h.select("a", "c", multiset_hash.combine(F.col("a"), F.col("b")).alias("put"), multiset_hash.combine(F.col("c"), F.col("b"), -1).alias("taken"))
    assert both.where("put = c and taken = a").count() == 1


@pytest.mark.parametrize("rows_a_range", [1, 2, 5, 100])
def test_next_row_over_ranges(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(multiset_hash, "FAN", 3)
    ids = [3, 1, 4, 15, 9, 2, 6, 53, 58, 97, 93, 23, 84, -62, 64, 33, 83, 27, 95, 88, 1 << 60, -(1 << 60)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r[0]: r[1] for r in multiset_hash.with_next(rows, "doc_id", ["text"]).select("doc_id", "next_text").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


@pytest.mark.parametrize("rows_a_range", [1, 100])
def test_next_row_of_null_and_repeated_ids(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", rows_a_range)
    rows = spark.createDataFrame([(None, "n"), (None, "n"), (2, "b"), (2, "b"), (1, "a"), (9, "z")], "doc_id long, text string")
    got = multiset_hash.with_next(rows, "doc_id", ["text"])
    pairs = sorted((r["text"], r["next_text"]) for r in got.collect())
    assert pairs == sorted([("z", "b"), ("b", "b"), ("b", "a"), ("a", "n"), ("n", "n"), ("n", "z")])
    alone = multiset_hash.with_next(rows.where("doc_id is null"), "doc_id", ["text"]).collect()
    assert [r["next_text"] for r in alone] == ["n", "n"]
    assert multiset_hash.compare_with_next(rows.limit(0)).count() == 0
    one = multiset_hash.compare_with_next(rows.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0 and one["edited"] == "z"


# ---- lexical search ----

def plain_search(rows, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))
    docs = [(i, Counter(terms(t))) for i, t, _ in rows if terms(t)]
    total, words, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = Counter(t for text in dict.fromkeys(t for i, t in items if i == item and t is not None) for t in terms(text))
        scored = []
        for i, c in docs:
            m = 100 - 75 + 75 * sum(c.values()) * total // words
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is not None, i, s))
        out += [(item, n, i, s) for n, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:3] if x[1] else x[:2])[:k], 1)]
    return out


SEARCHED = [(i, f"Alpha beta w{i % 7} x{i % 3} " * (1 + i % 5) + ("needle " if i % 11 == 0 else ""), "en") for i in range(120)] + [
    (500, None, "en"), (501, "", "en"), (502, ".,; --", "en"), (503, "Ünïque_wörd ALPHA1 needle", "en"), (None, "needle beta", "en"),
    (3, "needle w3", "en"), (3, "needle w3", "en"), (504, "beta " * 5000, "en"),
]
ITEMS = [(1, "needle, needle beta!"), (2, "w3 x1 ünïque"), (2, "w3 x1 ünïque"), (2, "second text beta"), (3, None), (4, ""), (5, "nothing here"), (None, "alpha Ünïque"), (6, "w1 w2 w3 w4 w5 w6 w0 x0 x1 x2")]


@pytest.mark.parametrize("k, seeds, rows", [(10, 20_000, 8192), (3, 5, 4), (1, 1, 16)])
def test_search_equals_brute_force(spark, monkeypatch, k, seeds, rows):
    for name, value in {"SEEDS": seeds, "BUCKET_ROWS": rows, "LEAST_ROWS": 2, "PART": 64}.items():
        monkeypatch.setattr(lexical_rank, name, value)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, term int")
    got = lexical_rank.search(docs_of(spark, SEARCHED).repartition(3), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(SEARCHED, ITEMS, k), key=key)


def test_search_in_blocks_of_items(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical_rank, "BLOCK_BYTES", 200)
    got = lexical_rank.search(docs_of(spark, SEARCHED), items, 4)
    assert {tuple(r) for r in got.collect()} == set(plain_search(SEARCHED, ITEMS, 4))


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_rank.search(docs_of(spark, []), items).count() == 0
    assert lexical_rank.search(docs_of(spark, [(1, None, None)]), items).count() == 0
    assert lexical_rank.search(docs_of(spark, SEARCHED), items.limit(0)).count() == 0


def test_buckets_hold_every_row_once(monkeypatch):
    norms = np.sort(np.concatenate((np.geomspace(1, 1e6, 40), np.full(30, 777.0))))[::-1]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(70)), pa.array(norms), pa.array([b""] * 70), pa.array([b""] * 70)], names=["id", "norm", "terms", "impacts"])
    parts = [batch.slice(k, 9) for k in range(0, 70, 9)]
    for least, most in ((2, 4), (5, 16), (1, 1)):
        monkeypatch.setattr(lexical_rank, "LEAST_ROWS", least)
        monkeypatch.setattr(lexical_rank, "BUCKET_ROWS", most)
        own = [b.ids.to_pylist() for b in lexical_rank._buckets(parts, 1)]
        assert [i for ids in own for i in ids] == list(range(70)) and max(map(len, own)) <= most

"""The pipeline's near copies against all pairs of exact five-word shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import shingle_sets, simhash

WORDS = [f"w{k}" for k in range(400)]
CLASHING = ("row", "text_key", "own_key", "own_pick", "pick", "least", "node", "id", "root")


def grams(text):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()


def plain_heads(rows):
    """The smallest id of each group that pairs of similarity 0.8 or more connect; null if it has none."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if (x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) > 0) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return Counter(min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group))


def edited(rng, words, many):
    own = list(words)
    for _ in range(many):
        at = rng.randrange(len(own))
        own[at:at + rng.choice((0, 1))] = [rng.choice(WORDS)] * rng.choice((0, 1))
    return " ".join(own)


@pytest.mark.parametrize("pairs_a_row", [shingle_sets.PAIRS_A_ROW, 0])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(shingle_sets, "PAIRS_A_ROW", pairs_a_row)  # 0: rounds of leaders come first
    monkeypatch.setattr(shingle_sets, "SAMPLE", 2)
    rng, texts = random.Random(6), [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    for size in (12, 60, 200, 700):
        for _ in range(5):
            base = rng.choices(WORDS, k=size)
            texts += [" ".join(base), *(edited(rng, base, int(size * share / 5)) for share in (0.02, 0.08, 0.1, 0.12, 0.2))]
    base = rng.choices(WORDS, k=150)  # one large group, and a line that many others share
    texts += [edited(rng, base, 2) for _ in range(60)] + [" ".join(base[:20] + rng.choices(WORDS, k=60)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(None if k % 50 == 7 else k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == plain_heads(rows)
    assert sum(got.values()) < simhash.deduplicate(docs).count()
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pairs_just_at_the_similarity_are_found(spark):
    # Of ten shingles nine are shared (0.82), four of five (exactly 0.8), six of eight (0.75).
    rows = [(0, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m o"), (2, "p q r s t u v w x"), (3, "p q r s t u v w"),
            (4, "A B1 C1 D1 E1 F1 G1 H1 I1 J1 K1 L1"), (5, "a b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 m1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == plain_heads(rows) == Counter([0, 2, 4, 5])


def test_fine_histograms_bound_what_large_sets_share(spark):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(5_000)]
    base = rng.choices(pool, k=1_100)
    texts = [" ".join(base), " ".join(base[:1_000]), " ".join(rng.choices(pool, k=8_000)), " ".join(rng.choices(pool, k=8_000))]
    sets = [shingle_sets.shingle_set(t) for t in texts]
    fine = [shingle_sets._fine(s) for s in sets]
    assert [len(f) for f in fine] == [256, 0, 1024, 1024]
    folded = shingle_sets._histogram(sets[1], 128)
    pairs = [(fine[2], fine[3]), (fine[0], folded)]
    rows = spark.createDataFrame([([int(v) for v in x], [int(v) for v in y]) for x, y in pairs], "x array<int>, y array<int>")
    apart, near = [r[0] for r in rows.select(shingle_sets._bound(F.col("x"), F.col("y"))).collect()]
    # CELLS cells alone leave two large sets without a common shingle for near copies.
    coarse = np.minimum(*(shingle_sets._histogram(s, shingle_sets.CELLS) for s in sets[2:])).sum()
    reach = lambda shared, x, y: 9 * shared >= 4 * (len(x) + len(y))
    assert reach(coarse, *sets[2:]) and not reach(apart, *sets[2:])
    assert near >= len(np.intersect1d(sets[0], sets[1])) == 996 and reach(near, *sets[:2])


def test_resolved_shingles_leave_the_rounds(spark):
    rows = [(1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 12, 12)]
    placed = spark.createDataFrame(rows, "key long, node long, comp long")
    assert {tuple(r) for r in shingle_sets._split(placed).collect()} == {(2, 10, 5), (2, 12, 12)}


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 6_000, np.int64))
    narrow = np.unique(rng.integers(0, 1 << 40, 400, np.int64))  # all in one class, so no second class can be shared
    missed = 0
    for many in [*range(1, 70), 127, 128, 160, 255, 256, 319, 1_000, 2_047, 2_048]:
        for source in (pool, narrow):
            if many > len(source) // 2:
                continue
            for _ in range(6):
                drawn = rng.permutation(source)
                common = np.sort(drawn[:many // 2])
                # The most that can differ: only taken away, only replaced, or both.
                for gone in {many // 5, many // 9, rng.integers(0, many // 5 + 1)}:
                    new = next((n for n in range(many // 9 + many // 5 + 1, -1, -1) if 5 * (many - gone) >= 4 * (many + n)), 0)
                    first, second = np.sort(drawn[:many]), np.sort(np.concatenate([drawn[gone:many], drawn[many:many + new]]))
                    assert 5 * (many - gone) >= 4 * (many + new)
                    for order in (pool[:0], common):
                        missed += not len(np.intersect1d(shingle_sets._prefix(first, order), shingle_sets._prefix(second, order)))
    assert missed == 0


def test_texts_with_a_line_in_common_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "SAMPLE", 1 << 30)  # the sample does not show that the line is common
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(3_000)]
    line = rng.choices(pool, k=14)
    texts = [" ".join(line + rng.choices(pool, k=190)) for _ in range(60)]
    base = rng.choices(pool, k=200)
    texts += [" ".join(base[:k] + base[k + 1:]) for k in range(20)]  # near copies share many keys, and each set of them counts once
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = shingle_sets._marks(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id").checkpoint()
    rows = shingle_sets._postings(marked)
    nodes = {r[0]: r[1] for r in marked.select("doc_id", "node").collect()}
    met = Counter(r["node"] for r in rows.collect())
    assert all(met[nodes[k]] for k in range(60, 80))
    assert sum(met[nodes[k]] for k in range(60)) < 20
    assert {r["node"]: r["n"] for r in marked.select("node", F.explode("prefix").alias("key")).groupBy("node").agg(F.count("*").alias("n")).collect()}[nodes[60]] > met[nodes[60]]


def test_parities_rule_out_pairs_of_a_large_group_before_they_are_rows(spark):
    rng = random.Random(11)
    base = rng.choices(WORDS, k=100)
    texts = [edited(rng, base, many) for many in [1] * 30 + [9] * 30]
    sets = [shingle_sets.shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(60) for j in range(i)]
    rows = [(len(sets[i]), shingle_sets._parities(sets[i]).tolist(), len(sets[j]), shingle_sets._parities(sets[j]).tolist()) for i, j in pairs]
    frame = spark.createDataFrame(rows, "size int, parity array<long>, size2 int, parity2 array<long>")
    may = [r[0] for r in frame.select(shingle_sets._near(*map(F.col, frame.columns))).collect()]
    similar = [9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) for i, j in pairs]
    assert all(m for m, s in zip(may, similar) if s) and sum(similar) > 300
    assert sum(may) - sum(similar) < 0.2 * (len(pairs) - sum(similar))

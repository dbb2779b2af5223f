"""Passages just above the similarity, whatever the distance of their fingerprints."""

import random

from docloom.llm import decontam


def plain_similarity(a, b):
    from collections import Counter
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_passages_just_above_the_similarity_are_found(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, texts = [], []
    for size, tail, kept in ((50, 5, 41), (100, 10, 81), (20, 2, 17), (60, 6, 49)):
        for _ in range(20):
            item = words(size)
            items.append(item)
            texts.append(words(7) + item[:-tail] + words(tail + 9))  # the end replaced
            texts.append(item[:kept])  # the end cut
            texts.append(words(9) + item[:-2 * tail] + words(9))  # too little of it
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    rows = decontam.leaks(docs, benchmark).collect()
    expected = {}
    for k, own in enumerate(texts):
        item = items[k // 3]
        best = max(plain_similarity(own[at:at + len(item)], item) for at in range(max(1, len(own) - len(item) + 1)))
        if best >= 0.8:
            expected[k, k // 3] = round(best, 9)
    assert {(r["doc_id"], r["item"]): round(r["similarity"], 9) for r in rows} == expected and len(expected) >= 120
    assert max(r["hamming"] for r in rows) > 11  # the former limit
    assert {r["doc_id"] for r in decontam.decontaminate(docs, benchmark).collect()} == set(range(len(texts))) - {k for k, _ in expected}

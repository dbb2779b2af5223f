"""The numpy side of ``term_cells``: bounds in whole numbers, then few rows in full."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.operators import term_cells


def weigh(tf, length, average):
    return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))


def brute(texts, question, share, average, k):
    found = []
    for i, words in enumerate(texts):
        score = round(math.fsum(share[t] * n * weigh(words.count(t), len(words), average) for t, n in question.items() if t in words), 9)
        if score > 0:
            found.append((-score, i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def search(texts, questions, share, average, k):
    counted = [Counter(words) for words in texts]
    rows = pa.table({"scope": [""] * len(texts), "terms": [list(c) for c in counted], "times": [list(c.values()) for c in counted], "numbers": pa.nulls(len(texts), pa.list_(pa.float64()))})
    asked = pa.table({
        "rep": list(range(len(questions))), "scope": [""] * len(questions), "terms": [list(q) for q in questions],
        "numbers": [[share[t] * n for t, n in q.items()] for q in questions], "average": [average] * len(questions),
        "cuts": pa.nulls(len(questions), pa.list_(pa.float64())),
    })
    mine, held = term_cells._Asked(asked, k, 0.0), []
    for start, size in ((0, 40), (40, 160), (200, len(texts) - 200)):
        held.append(term_cells._postings(mine, rows.slice(start, size), weigh))
        term_cells._score(mine, term_cells._Block(mine, held, start), float("inf"))
    return [[(int(r), s) for r, s in zip(mine.row[q], mine.score[q]) if r >= 0] for q in range(len(questions))]


@pytest.mark.parametrize("most", [0.9, 0.0])
def test_bounds_leave_few_rows_and_the_whole_ranking(monkeypatch, most):
    """Frequent terms as lines, rare ones as lists, repeated and uneven terms, sums of two and four bytes, equal texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    chance = [1 / (i + 1) for i in range(60)]
    texts = [rng.choices(words, chance, k=rng.randint(3, 90)) for _ in range(900)]
    texts[500:520] = [texts[3]] * 20
    average = sum(map(len, texts)) / len(texts)
    share = {t: math.log(1 + (900.5 - (d := sum(t in x for x in texts))) / (d + 0.5)) for t in words}
    questions = [{t: rng.choice((1, 1, 1, 2, 3)) for t in rng.sample(words, rng.randint(1, 25))} for _ in range(40)] + [{"w0": 3000, "w5": 2}, {"w59": 1}, {"w59": 2, "w1": 3}]
    monkeypatch.setattr(term_cells, "MOST_QUESTIONS", most)
    monkeypatch.setattr(term_cells, "BOUND_QUESTIONS", 7)
    full, blocks = [], []
    exact, near = term_cells._Block.exact, term_cells._near
    monkeypatch.setattr(term_cells._Block, "exact", lambda self, asked, rows, *a: full.append(len(rows)) or exact(self, asked, rows, *a))
    monkeypatch.setattr(term_cells, "_near", lambda block, kind, *a: blocks.append((kind, len(block.lines))) or near(block, kind, *a))
    got = search(texts, questions, share, average, 5)
    for found, question in zip(got, questions):
        want = brute(texts, question, share, average, 5)
        assert [r for r, _ in found] == [r for r, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-9)
    # Some rows of each block are scored over all terms, not every row that has one.
    matches = sum(any(t in x for t in q) for q in questions for x in texts)
    assert sum(full) < matches / 4
    assert any(lines for _, lines in blocks) and {kind for kind, _ in blocks} >= ({np.uint32} if most == 0.0 else {np.uint16})


def test_text_is_cleaned_and_split_once(spark):
    from docloom.operators import lexical
    from docloom.workload import retrieval_queries

    texts = [("c1", "bb aaa ccc aaa", ["aaa", "ccc", "aaa"]), ("c2", "", []), (None, "ddd", ["ddd"]), ("c3", None, None), ("c1", "ccc", ["ccc"])]
    rows = spark.createDataFrame(texts, "chunk_id string, exact_context string, tokens array<string>")
    got = lexical.prepared(rows, ["chunk_id"]).collect()
    assert sorted((r.chunk_id or "", sorted(zip(r.terms.split(term_cells.BREAK), r.times)), r.length) for r in got) == [
        ("", [("ddd", 1)], 1), ("c1", [("aaa", 2), ("ccc", 1)], 3), ("c1", [("ccc", 1)], 1)]
    # Titles of hits come from the rows that the search wrote.
    for name in ("dedupe_one_per_doc", "context_select"):
        plan = retrieval_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "exact_context" not in plan


def test_short_query_vectors_make_larger_blocks(spark, monkeypatch):
    from docloom.operators import vector

    monkeypatch.setattr(vector, "CELL_QUERIES", 2)
    monkeypatch.setattr(vector, "CELL_VALUES", 24)
    asked = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(17)] + [(99, None)], "q int, v array<double>")
    assert vector._blocks(asked) == 3 and vector._blocks(asked.limit(0)) == 1
    monkeypatch.setattr(vector, "CELL_VALUES", 1)
    assert vector._blocks(asked) == 9


def test_cells_of_both_sides_meet_in_every_task(spark, monkeypatch):
    """Without merged shuffle partitions, too, each query has its k nearest."""
    from docloom.operators import vector

    monkeypatch.setattr(vector, "CELL_QUERIES", 5)
    monkeypatch.setattr(vector, "CELL_VALUES", 1)
    monkeypatch.setattr(vector, "CELL_ROWS", 20)
    rng = random.Random(2)
    make = lambda n: [(i, i % 2, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(n)]
    table = spark.createDataFrame(make(70), "chunk_id int, s int, embedding array<double>")
    asked = spark.createDataFrame(make(23), "qid int, s int, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert vector.nearest_many(table, asked, 6).count() == 23 * 6
        assert vector.nearest_in_scope(table, asked, "s", 6).count() == 23 * 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

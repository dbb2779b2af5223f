"""Stored indexes and branches against plain recomputation."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from docloom.operators import branches, impact_index, lexical, vector, vector_cells
from docloom.workload import tables
from docloom.workload.retrieval_queries import source_corpus


def key_of(rows, *names):
    return sorted(tuple(r[n] if not isinstance(r[n], float) else round(r[n], 6) for n in names) for r in rows)


# ---- impact layers ----

def corpus_of(spark, seed, n=120, words=40):
    rng = random.Random(seed)
    vocabulary = [f"term{k}" for k in range(words)]
    rows = [(f"c{k:04d}", [vocabulary[min(int(rng.expovariate(0.15)), words - 1)] for _ in range(rng.randrange(1, 60))]) for k in range(n)]
    rows += [("c9998", ["term1"] * 300), ("c9999", ["term0", "term1", "term2"])]
    return spark.createDataFrame(rows, "chunk_id string, tokens array<string>")


QUESTIONS = [
    (1, "term0 term1 term2 term3"), (2, "term30 term31 term32"), (3, "term0"), (4, "nothing known"), (5, None), (6, ""),
    (7, "term1 term1 term1 term7 term0 term5 term9 term12"), (8, " ".join(f"term{k}" for k in range(40))), (9, "term39 term39 term0"),
]


@pytest.mark.parametrize("k, seeds", [(8, 2000), (3, 10), (1, 1), (500, 50)])
def test_pruned_search_equals_scoring_everything(spark, monkeypatch, k, seeds):
    monkeypatch.setattr(impact_index, "SEED_POSTINGS", seeds)
    corpus = corpus_of(spark, 3)
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    plain = lexical.search_many(corpus, questions, k).collect()
    index = impact_index.build(corpus)
    pruned = impact_index.search_many(index, questions, k)
    assert key_of(pruned.collect(), "qid", "chunk_id", "rank", "score", "distance") == key_of(plain, "qid", "chunk_id", "rank", "score", "distance")


def test_common_terms_are_left_unread(spark):
    """A question of one rare and one very common term reads few of the common one's postings."""
    rows = [(f"c{k:04d}", ["common"] * (1 + k % 3) + (["rare"] * 3 if k % 100 == 0 else []) + [f"w{k % 37}"] * 6) for k in range(1000)]
    corpus = spark.createDataFrame(rows, "chunk_id string, tokens array<string>")
    questions = spark.createDataFrame([(1, "common rare")], "qid int, question string")
    index = impact_index.build(corpus)
    read = impact_index.reading(index, questions, 5).first()
    assert read["postings"] == 1010 and read["read"] < 400
    assert key_of(impact_index.search_many(index, questions, 5).collect(), "chunk_id", "rank") == key_of(lexical.search_many(corpus, questions, 5).collect(), "chunk_id", "rank")


def test_stored_index_is_read_again(spark, tmp_path):
    corpus = corpus_of(spark, 4)
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    impact_index.write(corpus, str(tmp_path / "index"))
    again = impact_index.ImpactIndex.read(spark, str(tmp_path / "index"))
    got = impact_index.search_many(again, questions, 8).collect()
    assert key_of(got, "qid", "chunk_id", "rank") == key_of(lexical.search_many(corpus, questions, 8).collect(), "qid", "chunk_id", "rank")
    plan = again.postings.where("term = 'term3' and layer >= 4")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), IsNotNull(layer), EqualTo(term,term3), GreaterThanOrEqual(layer,4)]" in plan


def test_empty_corpus_and_no_questions(spark):
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    corpus = corpus_of(spark, 5)
    assert impact_index.search_many(impact_index.build(corpus.limit(0)), questions, 3).count() == 0
    assert impact_index.search_many(impact_index.build(corpus), questions.limit(0), 3).count() == 0


def test_rows_of_questions_and_postings_are_not_shuffled(spark, monkeypatch):
    """Many questions on a term that all documents hold: thresholds come from a few postings of it, matches stay in cells."""
    monkeypatch.setattr(impact_index, "HEAD_POSTINGS", 10)
    corpus = spark.range(2000).selectExpr("concat('c', lpad(id, 5, '0')) as chunk_id", "array('common', concat('w', id % 40), 'common', concat('v', id % 7)) as tokens")
    questions = spark.range(200).selectExpr("cast(id as int) as qid", "concat('common w', id % 40, ' v', id % 7) as question")
    index = impact_index.build(corpus)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = {tracker.stageList(None, False, False, getattr(tracker, "stageList$default$4")(), getattr(tracker, "stageList$default$5")()).apply(0).stageId()}
    got = impact_index.search_many(index, questions, 5).collect()
    stages = tracker.stageList(None, False, False, getattr(tracker, "stageList$default$4")(), getattr(tracker, "stageList$default$5")())
    wrote = [stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() > max(before)]
    assert max(wrote) < 50_000  # 200 questions on 2,000 documents are 400,000 matches
    assert key_of(got, "qid", "chunk_id", "rank") == key_of(lexical.search_many(corpus, questions, 5).collect(), "qid", "chunk_id", "rank")


# ---- vector cells ----

def clustered(rng, n, dims, centers, noise):
    base = rng.normal(size=(centers, dims))
    return [(int(i), (base[i % centers] + noise * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("noise, cells", [(0.05, 16), (5.0, 16), (0.3, 1)])
def test_cells_find_the_nearest_rows(spark, monkeypatch, noise, cells):
    monkeypatch.setattr(vector_cells, "PART_ROWS", 50)  # cells of several parts
    rng = np.random.default_rng(1)
    rows = clustered(rng, 600, 12, 9, noise)
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, rows[5][1]), (2000, rows[5][1])]  # ties and repeated rows
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(12)] + [(99, [1.0] * 12), (None, rows[3][1])], "qid long, embedding array<double>")
    index = vector_cells.build(table, cells)
    assert index.rows.count() == len(rows)
    for k in (1, 7, 700):
        got = vector_cells.nearest_many(index, queries, k).collect()
        want = vector.nearest_many(table, queries, k).collect()
        f = lambda rs: sorted(((r["qid"] is None, r["qid"] or 0, r["rank"], r["chunk_id"], round(r["distance"], 6)) for r in rs))
        assert f(got) == f(want)


def test_far_cells_are_not_read(spark):
    rows = clustered(np.random.default_rng(2), 2000, 16, 20, 0.02)
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = table.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "qid")
    read = vector_cells.reading(vector_cells.build(table, 20), queries, 5).collect()
    assert len(read) == 20 and all(r["rows"] == 2000 for r in read)
    assert sum(r["rows_read"] for r in read) < 0.2 * sum(r["rows"] for r in read)


def test_rows_without_direction_have_no_place(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0])]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = vector_cells.write(table, str(tmp_path / "cells"), 4)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None)], "qid long, embedding array<double>")
    got = vector_cells.nearest_many(vector_cells.CellIndex.read(spark, str(tmp_path / "cells")), queries, 9).collect()
    assert [(r["qid"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (1, 6)]
    assert vector_cells.nearest_many(index, queries.limit(0), 3).count() == 0
    assert vector_cells.nearest_many(vector_cells.build(table.limit(0), 4), queries, 3).count() == 0
    with pytest.raises(ValueError):
        vector_cells.build(table, 0)


# ---- branches ----

def hits_of(spark, rows):
    return spark.createDataFrame(rows, "qid int, chunk_id string, rank int, distance double").withColumns({
        "document_title": F.concat(F.lit("A long enough title "), "chunk_id"), "source_url": F.lit("https://www.nature.com/articles/x"),
        "exact_context": F.concat(F.lit("Some text that is long enough to be a passage of an answer, "), "chunk_id")})


def test_first_branch_with_a_usable_passage_answers(spark):
    near = hits_of(spark, [(1, "d1::a", 1, 0.1), (1, "d2::a", 2, 0.9), (2, "d1::a", 1, 0.9), (None, "d3::a", 1, 0.2)])
    words = hits_of(spark, [(1, "d9::a", 1, 0.99), (2, "d8::a", 1, 0.99), (3, "d7::a", 1, 0.95)])
    ways = [branches.Branch("vector", near, 0.5), branches.Branch("lexical", words)]
    got = {(r["qid"], r["branch"], r["chunk_id"], r["position"]) for r in branches.first_context(ways).collect()}
    assert got == {(1, "vector", "d1::a", 1), (None, "vector", "d3::a", 1), (2, "lexical", "d8::a", 1), (3, "lexical", "d7::a", 1)}
    # On hits alone, a far one still counts.
    by_hits = {(r["qid"], r["branch"]) for r in branches.first_hits(ways).collect()}
    assert by_hits == {(1, "vector"), (2, "vector"), (None, "vector"), (3, "lexical")}


def test_building_branches_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    hits = hits_of(spark, [(1, "d1::a", 1, 0.1)])
    before = set(tracker.getJobIdsForGroup(None))
    branches.first_context([branches.Branch("a", hits), branches.Branch("b", hits)])
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_both_ways_occur_over_the_given_tables(spark):
    import __spark_entry__ as entry

    routes = {r["mode"] for r in entry.queries()["vector_route"](spark, SF).select("mode").distinct().collect()}
    ways = {r["branch"] for r in entry.queries()["document_route_fallback"](spark, SF).select("branch").distinct().collect()}
    assert routes == {"vector", "lexical"} and ways == {"vector", "lexical"}


def test_index_over_the_given_tables_reads_less(spark):
    read = impact_index.reading(impact_index.build(source_corpus(spark, SF)), tables.questions(spark, SF), 8).first()
    assert 0 < read["read"] <= read["postings"]

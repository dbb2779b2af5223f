"""Plans and physical helpers that the scale decisions rest on."""

import os

from conftest import SF
from pyspark.sql import functions as F

from docloom.operators import chunking, narrowing
from docloom.session import fits_broadcast, keep_derived, materialize, release_work, spread, work_dir
from docloom.workload import tables


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_chunking_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = chunking.single_page(tables.with_catalog_columns(docs))
    plan = executed(chunking.chunk_records(rows, "t"))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_derived_rows_are_computed_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    derived = F.struct(F.upper("text").alias("loud"))
    plan = executed(keep_derived(docs, derived, lambda r: F.length(r["loud"]) > 10, ["doc_id"]))
    assert plan.count("upper(") == 1


def test_point_filter_reaches_the_scan(spark):
    plan = executed(tables.table(spark, SF, "embeddings").filter("vec_id = 0").select("embedding"))
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in plan


def test_size_check_and_spread(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
    wide = spark.range(100).repartition(50)
    assert spread(wide) is wide
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_intermediates_live_in_the_shared_folder(spark):
    kept = materialize(spark.range(5))
    assert kept.count() == 5
    folder = os.path.join(work_dir(spark), spark.sparkContext.applicationId)
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir") and os.listdir(folder)
    release_work(spark)
    assert not os.path.exists(folder)


def shuffled(frame):
    """What each exchange by a key receives, from the formatted plan."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    blocks = frame._jdf.queryExecution().explainString(mode).split("\n\n")
    return [b for b in blocks if "Exchange\n" in b and "RoundRobin" not in b and "BroadcastExchange" not in b]


def test_context_facts_stand_for_the_texts(spark):
    rows = [("a::1", 0.10, "A readable title", "Prose " * 20), ("a::2", 0.15, "A readable title", "short"), ("a::3", 0.2, "A readable title", "Prose " * 20),
            ("b::1", 0.3, "A readable title", None), ("plain", 0.4, "Another readable title", "Prose " * 20), ("plain2", 0.5, "Another readable title", "Prose " * 20)]
    texts = spark.createDataFrame([(c, t, "https://www.nature.com/articles/x", x) for c, _, t, x in rows], "chunk_id string, document_title string, source_url string, exact_context string")
    found = spark.createDataFrame([(1, c, i + 1, d) for i, (c, d, _, _) in enumerate(rows)], "qid int, chunk_id string, rank int, distance double")
    assert narrowing.context_facts(texts).columns == ["chunk_id", "_document", "_usable"]
    for limits in ({}, {"max_per_document": 1}, {"min_similarity": 0.85}):
        whole, narrow = (narrowing.select_context(found.join(side, "chunk_id"), **limits).select("qid", "position", "chunk_id").collect() for side in (texts, narrowing.context_facts(texts)))
        assert whole and sorted(whole) == sorted(narrow)


def test_search_terms_move_as_one_string(spark):
    from docloom.operators import term_cells

    rows = spark.createDataFrame([(1, ["aa", "bb"], [1.0, 2.0]), (2, [], []), (3, None, None), (4, ["bb"], [0.5])], "id long, terms array<string>, numbers array<double>")
    asked = spark.createDataFrame([(7, ["bb", "cc"], [2.0, 1.0], 1.0), (8, ["zz"], [1.0], 1.0)], "rep long, terms array<string>, numbers array<double>, average double")
    found = term_cells.best_rows(rows.withColumn("scope", F.lit("")), asked.withColumn("scope", F.lit("")), 2, key="id", counts=(4, 2))
    assert [b for b in shuffled(found) if "terms" in b] and "array_join(" in executed(found)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 1, 4.0), (7, 4, 1.0)]

"""A stored lexical index: postings sorted by term, document lengths, term frequencies.

Built once per corpus version; a question then reads the row groups of its own terms
instead of tokenising the corpus.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.functions.text import lexical_tokens_py
from docloom.operators import lexical


def build(corpus: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Write the index of ``searchable`` chunks.

    Postings are range-partitioned by term and key, so a term held by a third of all
    documents spreads over many files, and sorted, so a term filter skips row groups.
    """
    sized = corpus.select(key, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    postings = sized.groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf"))
    (
        postings.repartitionByRange("term", key).sortWithinPartitions("term", key)
        .write.mode("overwrite").parquet(f"{path}/postings")
    )
    lexical.corpus_statistics(corpus).write.mode("overwrite").parquet(f"{path}/statistics")
    stored = corpus.sparkSession.read.parquet(f"{path}/postings")
    (
        stored.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term")
        .sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    )


def search(
    spark: SparkSession, path: str, question: str, k: int | None = None, *, key: str = "chunk_id",
    cfg: Settings = DEFAULT,
) -> DataFrame:
    """Top ``k`` by BM25 from the stored index; the term filter reaches the scan."""
    k = k or cfg.top_k
    wanted = Counter(lexical_tokens_py(question))
    terms = list(wanted) or ["\u0001"]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(*terms))
    statistics = spark.read.parquet(f"{path}/statistics").select(F.struct("n", "avg_len").alias("s"))
    # A question has few terms: both tables below hold at most one row per term.
    frequency = spark.read.parquet(f"{path}/terms").filter(F.col("term").isin(*terms))
    times = spark.createDataFrame([(t, n) for t, n in wanted.items()], "term string, times int")
    weights = frequency.join(F.broadcast(times), "term").withColumn("s", statistics.scalar()).select(
        "term",
        (F.col("times") * lexical.inverse_frequency(F.col("s.n"), F.col("df"))).alias("idf"),
        F.col("s.avg_len").alias("avg_len"),
    )
    part = F.col("idf") * lexical.term_weight(
        F.col("tf").cast("double"), F.col("doc_len"), F.col("avg_len"), cfg
    )
    top = (
        postings.join(F.broadcast(weights), "term")
        .groupBy(key)
        .agg(F.round(F.sum(part), 9).alias("score"))
        .orderBy(F.col("score").desc(), F.col(key))
        .limit(k)
    )
    order = Window.orderBy(F.col("score").desc(), F.col(key))  # at most k rows
    return top.withColumn("rank", F.row_number().over(order)).withColumn(
        "distance", lexical.pseudo_distance(F.col("score"))
    )

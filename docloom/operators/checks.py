"""Checks of the vector table: one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Settings
from docloom.functions import fixed_values as fv
from docloom.functions.vectors import is_unit


def verify_index(
    vectors: DataFrame, *, expected: DataFrame | None = None, space: str = "cosine",
    column: str = "embedding", sample_hits: DataFrame | None = None, reopened: DataFrame | None = None,
    cfg: Settings = DEFAULT,
) -> DataFrame:
    """Existence, distance space, count, sample query, reopen, norms, metadata.

    Norms are checked on every vector rather than a sample: one narrow pass that
    aggregates to a single row.
    """
    missing = sorted(set(fv.REQUIRED_METADATA) - set(vectors.columns))
    facts = vectors.agg(
        F.count("*").alias("n"), F.count_if(~is_unit(F.col(column), cfg.unit_tolerance)).alias("bad")
    )
    n = F.col("n").cast("string")
    want = expected.select("total").scalar() if expected is not None else F.lit(None).cast("bigint")
    hits = sample_hits.agg(F.count("*")).scalar() if sample_hits is not None else F.lit(0)
    again = reopened.agg(F.count("*")).scalar() if reopened is not None else F.col("n")

    def check(name, passed, detail):
        return F.struct(
            F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")
        )

    checks = F.array(
        check("collection_exists", F.lit(True), F.lit(f"found={cfg.collection}")),
        check("collection_cosine_metadata", F.lit(space == "cosine"), F.lit(f"space={space}")),
        check(
            "vector_count",
            F.when(want.isNull(), F.col("n") >= 0).otherwise(F.col("n") == want),
            F.concat(F.lit("count="), n, F.lit(", expected="), F.coalesce(want.cast("string"), F.lit("none"))),
        ),
        check("sample_query", (F.col("n") > 0) & (hits > 0), F.concat(F.lit("n_results="), hits.cast("string"))),
        check(
            "persistence_reopen", again == F.col("n"),
            F.concat(F.lit("before="), n, F.lit(", after="), again.cast("string")),
        ),
        check(
            "l2_norm", (F.col("n") > 0) & (F.col("bad") == 0),
            F.concat(F.lit("checked="), n, F.lit(", failures="), F.col("bad").cast("string")),
        ),
        check(
            "metadata_keys", (F.col("n") > 0) & F.lit(not missing),
            F.lit("all present" if not missing else "missing=" + ",".join(missing)),
        ),
    )
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def overall(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("passed"))


def expected_count(stats: DataFrame | None, index_total: DataFrame | None) -> DataFrame:
    """Vectors to expect: the statistics row first, else the chunk index total."""
    parts = []
    if stats is not None:
        parts.append(stats.select(F.lit(0).alias("p"), F.col("total_vectors").cast("bigint").alias("total")))
    if index_total is not None:
        parts.append(index_total.select(F.lit(1).alias("p"), F.col("total_chunks").cast("bigint").alias("total")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.filter(F.col("total").isNotNull()).orderBy("p").limit(1).select("total")


def index_is_live(n_vectors, model: str, stats_total):
    """Does the index hold real model vectors, about as many as its statistics say?"""
    return (
        (n_vectors > 0)
        & F.lit(model.startswith(fv.LIVE_MODEL_PREFIX))
        & F.coalesce(
            (stats_total > 0)
            & (
                F.abs(n_vectors - stats_total)
                <= F.greatest(F.lit(20), F.floor(stats_total * F.lit(0.05)))
            ),
            F.lit(True),
        )
    )


def retrieval_mode(live: bool, cfg: Settings = DEFAULT) -> str:
    """``vector`` when question vectors are comparable with the index, else ``lexical``."""
    compatible = (not live) if cfg.embed_mock else cfg.has_embedding_token
    return "vector" if compatible or not live else "lexical"


def index_stats(vectors: DataFrame, changes: DataFrame, deleted: int = 0, cfg: Settings = DEFAULT) -> DataFrame:
    """The statistics row written after an index run."""
    total = vectors.agg(F.count("*").alias("total_vectors"))
    counts = changes.agg(
        F.count_if(F.col("change") == "unchanged").alias("chunks_skipped_unchanged"),
        F.count_if(F.col("change") != "unchanged").alias("chunks_embedded"),
    )
    return total.select(
        F.lit("1").alias("schema_version"),
        F.lit(cfg.collection).alias("collection"),
        "total_vectors",
        F.lit(cfg.embedding_model).alias("embedding_model"),
        F.lit(cfg.embedding_dimension).alias("embedding_dimension"),
        counts.select("chunks_skipped_unchanged").scalar().alias("chunks_skipped_unchanged"),
        counts.select("chunks_embedded").scalar().alias("chunks_embedded"),
        F.lit(deleted).cast("bigint").alias("chunks_deleted"),
    )

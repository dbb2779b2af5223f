"""Session construction and the few physical-layout helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below this.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app_name: str = "docloom", cores: str = "*", **conf) -> SparkSession:
    """Local session for tests and benches; on a cluster pass an existing session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture on every column operation dominates plan construction.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan that has fewer splits than cores; a no-op on a large scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return configured or os.path.join(tempfile.gettempdir(), "docloom-work")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    For a small intermediate that several branches of a plan read: it is computed once,
    carries real statistics, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_work(spark: SparkSession) -> None:
    """Delete this application's written intermediates; call when its results are stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(
        f"{work_dir(spark)}/{spark.sparkContext.applicationId}"
    )
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` provably holds at most ``limit`` rows (stops counting past it)."""
    return df.limit(limit + 1).count() <= limit


def keep_derived(df: DataFrame, derived: Column, keep, columns: list[str]) -> DataFrame:
    """Keep ``columns`` and the fields of struct ``derived`` for rows where ``keep`` holds.

    A filter over derived columns would be pushed below them and evaluate the whole
    derivation again.  Going through a generator evaluates it exactly once per row; the
    outer form also keeps the optimiser from inferring a second evaluation.
    """
    kept = df.select(*columns, F.explode_outer(F.filter(F.array(derived), keep)).alias("_kept"))
    return kept.filter(F.col("_kept").isNotNull()).select(*columns, "_kept.*")


def explode_rows(df: DataFrame, rows: Column, columns: list[str]) -> DataFrame:
    """One output row per struct of the array ``rows``, which is evaluated once."""
    out = df.select(*columns, F.explode_outer(rows).alias("_row"))
    return out.filter(F.col("_row").isNotNull()).select(*columns, "_row.*")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a column expression: ``body`` receives a lambda variable.

    Without it an expensive expression used twice, or used inside a higher-order
    function, is evaluated again at each use.
    """
    return F.transform(F.array(value), body).getItem(0)

"""The JSON and JSON-lines containers: catalog, chunks, chunk index, statistics, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas

VERSION = "1"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _container(spark: SparkSession, path: str, schema, mode: str = "FAILFAST") -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def _checked(rows: DataFrame) -> DataFrame:
    """Fail on a container of another schema version."""
    return rows.withColumn(
        "schema_version",
        F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(
            F.raise_error(F.concat(F.lit("unsupported schema_version: "), F.col("schema_version")))
        ),
    ).filter(F.col("schema_version").isNotNull())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of a manifest file; an absent file is an empty catalog."""
    return _checked(_container(spark, path, schemas.MANIFEST)).select(F.inline("documents"))


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    return _container(spark, path, schemas.MANIFEST).select(
        F.explode("pruned_document_ids").alias("document_id")
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of JSON-lines files (a file, folder or glob); blank lines are skipped."""
    return (
        spark.read.schema(schemas.CHUNK).option("mode", "FAILFAST").option("ignoreMissingFiles", True)
        .json(path)
    )


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    return _checked(_container(spark, path, schemas.CHUNK_INDEX)).select(F.inline("documents"))


def read_indexed_chunks(spark: SparkSession, index_path: str, chunk_glob: str) -> DataFrame:
    """Chunks of the documents an index lists; listed documents without a file are absent."""
    index = read_chunk_index(spark, index_path).select("document_id")
    return read_chunks(spark, chunk_glob).join(index, "document_id", "left_semi")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics row; unreadable JSON counts as no statistics."""
    return _container(spark, path, schemas.STATS, "PERMISSIVE").filter(
        F.col("total_vectors").isNotNull()
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their open-ended fields in a map."""
    fields = F.from_json("value", "map<string,string>")
    known = ("timestamp", "event", "source")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(fields.alias("m"))
    return lines.select(
        *[F.col("m")[k].alias(k) for k in known],
        F.map_filter("m", lambda k, v: ~k.isin(*known)).alias("attrs"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows; every write adds files, so concurrent runs do not clash."""
    line = F.to_json(
        F.map_concat(
            F.map_filter(
                F.create_map(
                    F.lit("timestamp"), F.col("timestamp"), F.lit("event"), F.col("event"),
                    F.lit("source"), F.col("source"),
                ),
                lambda k, v: v.isNotNull(),
            ),
            "attrs",
        )
    )
    rows.select(line.alias("value")).write.mode("append").text(path)

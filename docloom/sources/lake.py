"""Parquet tables of the pipeline, bucketed by document so that merges touch few files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize
from docloom.sources.json_tables import _exists

BUCKETS = 256


def bucket_of(document_id, buckets: int = BUCKETS):
    """Partition value of a document; a hash, because one folder per document cannot scale."""
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table, also one that ``df`` itself reads."""
    materialize(df).write.mode("overwrite").parquet(path)


def merge_by_document(
    incoming: DataFrame, replaced: DataFrame, path: str, schema, buckets: int = BUCKETS
) -> None:
    """Replace all rows of the documents in ``replaced`` by ``incoming``.

    Only the bucket folders of those documents are read and rewritten; each is replaced
    as a whole by the commit protocol, so a failed write leaves the old content.
    """
    spark = incoming.sparkSession
    # Written first: ``replaced`` may itself be derived from the table that is rewritten.
    touched = materialize(
        replaced.select("document_id").distinct().withColumn(
            "bucket", bucket_of(F.col("document_id"), buckets)
        )
    )
    new = incoming.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    merged = new
    if _exists(spark, path):
        full = T.StructType([f for f in schema.fields if f.name != "bucket"])
        stored = spark.read.schema(full.add("bucket", T.IntegerType())).parquet(path)
        # At most ``buckets`` values: the join prunes folders when the query runs.
        stored = stored.join(F.broadcast(touched.select("bucket").distinct()), "bucket", "left_semi")
        kept = stored.join(touched.select("document_id"), "document_id", "left_anti")
        merged = kept.select(*new.columns).unionByName(new)
    out = materialize(merged)
    (
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path)
    )
    # A bucket that lost its last row is not in the output, so its folder goes explicitly.
    _drop_folders(spark, path, touched.join(out.select("bucket").distinct(), "bucket", "left_anti"))


def _drop_folders(spark: SparkSession, path: str, emptied: DataFrame) -> None:
    """Remove the folders of buckets without rows; at most ``BUCKETS`` names reach the driver."""
    names = [r["bucket"] for r in emptied.select("bucket").distinct().collect()]
    for name in names:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={name}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

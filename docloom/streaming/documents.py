"""New documents to the chunk table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schemas
from docloom.config import DEFAULT, Settings
from docloom.functions.dates import parse_instant
from docloom.operators import chunking
from docloom.sources import lake


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_chunking(
    documents: DataFrame, chunk_path: str, checkpoint_path: str, *, buckets: int = lake.BUCKETS,
    cfg: Settings = DEFAULT,
):
    """Chunk each arriving document version and merge it by document.

    ``documents``: catalog columns plus ``pages``.  Within a batch the latest version of a
    document wins; a version that is not newer than the stored one is ignored, so a
    replayed or late batch changes nothing.  The chunk's ``created_at`` is the document's
    ingestion time, which keeps the result the same on replay.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        latest = Window.partitionBy("document_id").orderBy(parse_instant(F.col("ingested_at")).desc())
        newest = batch.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") == 1).drop("_n")
        done = (
            lake.read_table(spark, chunk_path, schemas.CHUNK)
            .join(newest.select("document_id"), "document_id", "left_semi")
            .groupBy("document_id")
            .agg(F.max("created_at").alias("source_ingested_at"))
        )
        pending = chunking.pending_documents(newest, done)
        made = chunking.drop_pii_chunks(chunking.chunk_records(pending, "", cfg)).drop("created_at")
        stamped = made.join(
            pending.select("document_id", F.col("ingested_at").alias("created_at")), "document_id"
        ).select(*schemas.CHUNK.names)
        lake.merge_by_document(
            stamped, pending.select("document_id"), chunk_path, schemas.CHUNK, buckets
        )

    return (
        documents.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )

"""Declared schemas of the stored tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

DOCUMENT = _struct(
    document_id=_S, source_org=_S, source_url=_S, document_title=_S, publication_date=_S,
    ingested_at=_S, content_type=_S, local_path=_S, chronological_rank=_I,
)
MANIFEST = _struct(
    schema_version=_S, documents=T.ArrayType(DOCUMENT), pruned_document_ids=T.ArrayType(_S)
)
CHUNK = _struct(
    chunk_id=_S, document_id=_S, source_org=_S, source_url=_S, document_title=_S,
    publication_year=_I, page_number=_I, chunk_index=_I, exact_context=_S, token_count=_I,
    char_count=_I, verification_status=_S, content_hash=_S, created_at=_S,
)
CHUNK_INDEX = _struct(
    schema_version=_S, generated_at=_S, total_chunks=T.LongType(),
    documents=T.ArrayType(
        _struct(document_id=_S, chunk_file=_S, chunk_count=T.LongType(), content_hash=_S)
    ),
)
CHECKPOINT = _struct(
    document_id=_S, source_ingested_at=_S, chunk_count=T.LongType(), pipeline_version=_S
)
STATS = _struct(
    schema_version=_S, collection=_S, total_vectors=T.LongType(), embedding_model=_S,
    embedding_dimension=_I, last_indexed_at=_S, chunks_skipped_unchanged=T.LongType(),
    chunks_embedded=T.LongType(), chunks_deleted=T.LongType(), chunks_errors=T.LongType(),
    dry_run=_B,
)
LOG = _struct(timestamp=_S, event=_S, source=_S, attrs=T.MapType(_S, _S))

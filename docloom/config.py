"""Constants that change results, gathered in one immutable settings object."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # retrieval
    top_k: int = 8
    context_chunks: int = 3
    max_citations: int = 1
    max_per_document: int = 1
    list_max_documents: int = 3
    min_similarity: float = 0.18
    max_distance: float = 0.78
    gate_min_similarity: float = 0.22
    gate_min_term_overlap: float = 0.08
    lexical_max_distance: float = 0.92
    ambiguity_ratio: float = 1.15
    ambiguity_slack: float = 0.08
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    # title resolution
    resolve_min_score: float = 0.48
    resolve_min_gap: float = 0.06
    resolve_date_bonus: float = 0.12
    # chunking
    soft_max_tokens: int = 400
    max_tokens: int = 512
    overlap_tokens: int = 80
    min_section_chars: int = 20
    pii_review_ratio: float = 0.30
    pipeline_version: str = "1.0.0"
    # embedding
    embed_batch_size: int = 16
    embed_max_chars: int = 24_000
    embedding_dimension: int = 1024
    embedding_model: str = "BAAI/bge-large-en-v1.5"
    collection: str = "india_medical_local"
    unit_tolerance: float = 1e-5
    embed_mock: bool = False
    has_embedding_token: bool = False
    # corpus
    max_download_mb: int = 12

    @property
    def fetch_k(self) -> int:
        return max(self.top_k * 2, 12)

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULT = Settings()

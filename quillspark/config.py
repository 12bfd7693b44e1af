"""Settings of retrieval and ingestion, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    chunk_min: int = 800
    chunk_max: int = 1200
    table_max: int = 700
    faq_max: int = 900
    snippet: int = 450
    recall: int = 60
    oversample: int = 3
    rrf_k: int = 60
    routed: int = 8
    pool: int = 12
    final: int = 5
    min_score: float = 0.35
    weights: dict = field(default_factory=lambda: {"dense": 0.25, "lexical": 0.25, "phrase": 0.15, "section": 0.15, "rrf": 0.05, "document": 0.10, "subject": 0.10, "quality": 0.05, "rerank": 0.15})
    dense_floor: float = 0.72
    dense_strict: float = 0.88
    min_overlap: float = 0.01
    document_gate: float = 0.45
    extreme_dense: float = 0.90
    extreme_rerank: float = 0.92
    adaptive_floor: float = 0.55
    adaptive_gap: float = 0.18
    mmr_lambda: float = 0.85
    mmr_similar: float = 0.82
    subject_sure: float = 0.65
    subject_mismatch: float = 0.25
    subject_penalty: float = 0.25
    toc_penalty: float = 0.55
    low_quality_penalty: float = 0.3
    routing_min: float = 0.12
    neighbours: int = 1
    context_chars: int = 1800


DEFAULT = Settings()

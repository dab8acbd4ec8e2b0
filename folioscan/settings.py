"""Default parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that decide the results.


@dataclass(frozen=True)
class Bm25Settings:
    k1: float = 1.5
    b: float = 0.75
    #: ``okapi_floor``: ln((N-n+.5)/(n+.5)), negative values replaced by
    #: ``epsilon`` times the mean idf; ``plus1``: ln(1+(N-n+.5)/(n+.5))
    idf: str = "okapi_floor"
    epsilon: float = 0.25


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 8
    rrf_k: int = 60
    max_per_doc: int = 2
    candidate_cap: int = 400
    rerank_pool: int = 10
    rerank_top_n: int = 3
    rerank_top_n_complex: int = 5
    per_topic_k: int = 3
    min_topics: int = 2


@dataclass(frozen=True)
class ChunkSettings:
    size: int = 1200
    overlap: int = 200
    citation_size: int = 500
    min_page_chars: int = 150
    citation_merge_chars: int = 80


@dataclass(frozen=True)
class HistorySettings:
    window: int = 4
    overlap_threshold: float = 0.15
    min_terms: int = 3
    preview_chars: int = 220
    max_topics: int = 5
    segment_on_shift: bool = True
    anaphora_skips_last_shift: bool = True

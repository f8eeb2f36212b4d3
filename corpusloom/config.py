"""Settings, checked when they are made; every knob of a pipeline lives in one of these."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

#: Optional word segmenters, the most wanted first.
SEGMENTERS = ("underthesea", "pyvi")


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 1800
    overlap_chars: int = 250
    min_chunk_chars: int = 300

    def __post_init__(self):
        require(self.max_chars > 0, "max_chars must be positive")
        require(0 <= self.overlap_chars < self.max_chars, "overlap_chars must be at least 0 and below max_chars")
        require(0 <= self.min_chunk_chars <= self.max_chars, "min_chunk_chars must lie between 0 and max_chars")


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self):
        require(self.k1 > 0 and 0 <= self.b <= 1, "k1 must be positive and b lie between 0 and 1")


@dataclass(frozen=True)
class TokenizerConfig:
    backend: str = "regex"  # regex, a word segmenter by its module's name, or auto: the first installed segmenter, else regex
    phrases: tuple[str, ...] | None = None  # None: the default list
    phrase_boost: int = 1
    lowercase: bool = True
    repair_mojibake: bool = True

    def __post_init__(self):
        require(self.phrase_boost >= 0, "phrase_boost cannot be negative")
        require(self.backend in ("auto", "regex", *SEGMENTERS), f"backend must be one of auto, regex, {', '.join(SEGMENTERS)}")
        require(self.backend not in SEGMENTERS or self.resolved == self.backend, f"{self.backend} is not installed")

    @property
    def resolved(self) -> str:
        """The backend that is there for this one."""
        tried = SEGMENTERS if self.backend == "auto" else (self.backend,)
        return next((m for m in tried if m in SEGMENTERS and importlib.util.find_spec(m)), "regex")


@dataclass(frozen=True)
class RetrievalConfig:
    sparse_weight: float = 0.7
    per_query_top_k: int = 20
    oversample_factor: int = 5
    candidate_pool_size: int = 50
    scope_candidates_per_branch: int = 5
    max_chunks_per_article: int = 2
    ambiguous_max_chunks_per_article: int = 1
    scope_relevance_margin: float = 0.15
    rrf_k: int = 60

    def __post_init__(self):
        for name in ("per_query_top_k", "oversample_factor", "candidate_pool_size", "scope_candidates_per_branch", "max_chunks_per_article", "ambiguous_max_chunks_per_article", "rrf_k"):
            require(getattr(self, name) > 0, f"{name} must be positive")
        require(0 < self.sparse_weight <= 1, "sparse_weight must lie in (0, 1]")
        require(self.scope_relevance_margin > 0, "scope_relevance_margin must be positive")

    @property
    def raw_k(self) -> int:
        return self.per_query_top_k * self.oversample_factor


@dataclass(frozen=True)
class CitationConfig:
    exact_lookup: tuple[int, int] = (1, 1)  # documents, articles
    simple: tuple[int, int] = (2, 2)
    multi_issue: tuple[int, int] = (3, 5)
    min_score: float | None = None
    score_margin: float | None = None

    def __post_init__(self):
        require(all(x > 0 for pair in (self.exact_lookup, self.simple, self.multi_issue) for x in pair), "quotas must be positive")
        require(self.score_margin is None or self.score_margin >= 0, "score_margin cannot be negative")


@dataclass(frozen=True)
class ContextConfig:
    per_context: int = 3000
    total: int = 16000

    def __post_init__(self):
        require(self.per_context > 0 and self.total > 0, "context limits must be positive")


@dataclass(frozen=True)
class ImportConfig:
    dim: int = 1024
    batch_size: int = 512
    max_retries: int = 5
    start_file: int | None = None
    recreate: bool = False

    def __post_init__(self):
        require(self.dim > 0 and self.batch_size > 0 and self.max_retries >= 0, "dim and batch_size must be positive, max_retries at least 0")
        require(self.start_file is None or self.start_file >= 0, "start_file cannot be negative")

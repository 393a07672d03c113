"""Constants of ranking, refusal, chunking and capture, in one place. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    k1: float = 1.2
    b: float = 0.75
    weight_name: float = 3.0
    weight_description: float = 2.0
    weight_headings: float = 1.5
    weight_key_facts: float = 2.5
    weight_body: float = 0.3
    fuse_keyword: float = 0.42
    fuse_semantic: float = 0.42
    fuse_phrase: float = 0.16
    phrase_dead_band: float = 0.35
    rerank: int = 30
    snippet_chars: int = 320
    cosine_floor: float = 0.40
    cosine_span: float = 0.30
    keyword_abs_floor: float = 8.0
    keyword_abs_full: float = 20.0
    keyword_cov_floor: float = 0.60
    keyword_cov_full: float = 0.85
    long_doc_alpha: float = 0.35
    long_doc_waiver: float = 0.45
    archive_share: float = 0.5
    slots_per_document: int = 1
    absence_score: float = 0.38
    absence_phrase: float = 0.40
    absence_coverage: float = 0.20
    absence_orphans: float = 0.40
    weak_results: int = 3
    boost_archive: float = 1.0
    boost_hot: float = 1.15
    boost_hot_indexed: float = 1.25
    recency_floor: float = 0.85
    recency_days: float = 180.0
    limit: int = 8
    spread_alpha: float = 0.10
    spread_gate: float = 0.20
    spread_from: int = 10
    spread_corpora: tuple[str, ...] = field(default=("curated",))
    state_terms: int = 20_000
    chunk_words: int = 200
    chunk_overlap: int = 40
    chunk_cap: int = 200
    section_min_doc: int = 20_000
    section_min_count: int = 3
    section_min_chars: int = 200
    section_keep: int = 3
    section_beta: float = 1.0
    inline_changes: int = 8
    inline_first_build: int = 40
    commit_grace_minutes: int = 30
    commits_per_exchange: int = 12
    retry_seconds: int = 180
    quiet_minutes: int = 10
    short_reply: int = 200
    short_ask: int = 40
    supersede_score: float = 0.55
    supersede_terms: int = 3
    supersede_share: float = 0.34
    unindexed_files: int = 50
    unindexed_bytes: int = 5_000_000
    embedding_dim: int = 384
    scopes: tuple[str, ...] = field(default=("curated", "projects", "staging", "handoff"))


CONFIG = EngineConfig()

#: Words that carry no search weight. Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "how", "i", "if", "in", "into",
    "is", "it", "its", "my", "of", "on", "or", "that", "the", "then", "there", "these", "this", "to", "was", "what",
    "when", "where", "which", "who", "will", "with", "you", "your", "me", "we", "can", "should", "would", "about", "use",
    "using",
)

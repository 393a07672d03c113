"""Scalar parts of a score as Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from loomery.config import CONFIG, EngineConfig


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def idf(n_docs: Column, df: Column) -> Column:
    """A04"""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def dot(a: Column, b: Column) -> Column:
    """Products summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rescale_cosine(c: Column, cfg: EngineConfig = CONFIG) -> Column:
    """X02"""
    return clamp01((c - cfg.cosine_floor) / cfg.cosine_span)


def keyword_size(raw: Column, ideal: Column, cfg: EngineConfig = CONFIG) -> Column:
    """The magnitude between floor and full score, 0 to 1; null without an ideal above 0."""
    low = F.least(F.lit(cfg.keyword_abs_floor), cfg.keyword_cov_floor * ideal)
    high = F.least(F.lit(cfg.keyword_abs_full), cfg.keyword_cov_full * ideal)
    return F.when(ideal > 0, clamp01((raw - low) / F.nullif(high - low, F.lit(0.0))))


def absolute_keyword(raw: Column, ideal: Column, cfg: EngineConfig = CONFIG) -> Column:
    """Null where the magnitude is not above 0, which drops the document from the keyword leg."""
    size = keyword_size(raw, ideal, cfg)
    return F.when(size > 0, size * clamp01((raw / ideal) / cfg.keyword_cov_floor))


def phrase_part(phrase: Column, cfg: EngineConfig = CONFIG) -> Column:
    """Nothing up to the dead band, then a line up to 1."""
    return F.when(phrase > cfg.phrase_dead_band, (phrase - cfg.phrase_dead_band) / (1 - cfg.phrase_dead_band)).otherwise(0.0)


def long_doc_factor(n: Column, reference: Column, keyword: Column, cfg: EngineConfig = CONFIG) -> Column:
    """Documents with more chunks than the reference lose weight unless their keyword score waives it."""
    raw = F.pow(reference / n, F.lit(cfg.long_doc_alpha))
    return F.when(n <= reference, 1.0).otherwise(raw + (1 - raw) * clamp01(keyword / cfg.long_doc_waiver))


def section_chunks(own: Column, parent: Column, beta: float = 1.0) -> Column:
    """A section's bulk between its own chunks (beta 0) and its parent's (beta 1)."""
    if beta <= 0:
        return own
    if beta >= 1:
        return parent
    return F.exp((1 - beta) * F.log(F.greatest(own, F.lit(1))) + beta * F.log(F.greatest(parent, F.lit(1))))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_millis(a) - F.unix_millis(b)) / 86_400_000.0


def recency_factor(modified: Column, as_of: datetime | Column, cfg: EngineConfig = CONFIG) -> Column:
    """A decay towards a floor; 1 without a date."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = F.greatest(F.lit(0.0), days_between(now, modified))
    return F.when(modified.isNull(), 1.0).otherwise(cfg.recency_floor + (1 - cfg.recency_floor) * F.exp(-age / cfg.recency_days))


def near_factor(modified: Column, near: Column, cfg: EngineConfig = CONFIG) -> Column:
    """Closeness to a date, halved every ``recency_days``, scaled to the recency range; 1 without a date."""
    age = F.abs(days_between(near, modified))
    return F.when(modified.isNull() | near.isNull(), 1.0).otherwise(cfg.recency_floor + (1 - cfg.recency_floor) * F.pow(F.lit(0.5), age / cfg.recency_days))


def tier_boost(tier: Column, listed: Column, cfg: EngineConfig = CONFIG) -> Column:
    return F.when(tier == "archive", cfg.boost_archive).when(listed, cfg.boost_hot_indexed).otherwise(cfg.boost_hot)


def provenance(keyword: Column, semantic: Column, phrase: Column) -> Column:
    """X09"""
    return F.when((keyword > 0) & (semantic > 0.35), "both").when(keyword > 0, "keyword").when(phrase > 0.2, "phrase").otherwise("semantic")

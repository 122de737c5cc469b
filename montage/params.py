"""Constants that are part of the operators' meaning, as one value to pass on or replace."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # segmentation, in seconds
    target_s: float = 8.0
    min_s: float = 6.0
    max_s: float = 10.0
    last_min_s: float = 1.0
    duration_weight: float = 0.35
    silence_gap_s: float = 0.25
    penalties: dict[str, float] = field(default_factory=lambda: {"sentence": 0.0, "clause": 0.35, "silence": 0.7, "word": 1.2})
    # entity resolution
    apply_threshold: float = 0.75
    fuzzy_threshold: float = 0.86
    method_weights: dict[str, float] = field(default_factory=lambda: {"override": 1.0, "exact": 1.0, "fuzzy": 0.92, "phonetic": 0.88, "llm": 1.0})
    # analysis and search strings
    batch_size: int = 20
    min_queries: int = 4
    keyword_chars: int = 4
    keyword_words: int = 6
    # gathering and validation
    candidates: int = 30
    keep: int = 8
    max_bytes: int = 15_728_640
    min_width: int = 800
    hamming_distance: int = 6
    provider_caps: dict[str, int] = field(default_factory=lambda: {"wikimedia": 2})
    # ranking
    weights: dict[str, float] = field(default_factory=lambda: {"clip": 0.45, "entity": 0.2, "source": 0.1, "resolution": 0.1, "sharpness": 0.1, "repetition": 0.15})
    exact_event_weight: float = 0.10
    watermark_weight: float = 0.15
    diversity: float = 0.8
    shape_penalty: float = 0.05
    history: int = 6
    # locating moments and clips
    method_confidence: dict[str, float] = field(default_factory=lambda: {"captions": 0.92, "chapters": 0.80, "description": 0.70, "metadata": 0.50, "similarity": 0.35})
    class_confidence: dict[str, float] = field(default_factory=lambda: {"EXACT_SCENE": 0.90, "LIKELY_EXACT_SCENE": 0.75, "RELATED_FOOTAGE": 0.60, "CONTEXTUAL": 0.30})
    clip_min_confidence: float = 0.45
    padding_s: float = 3.0
    clips_per_segment: int = 1
    # delivery
    high: float = 0.85
    medium: float = 0.60
    # control
    cache_ttl_s: int = 30 * 86_400
    stale_after_s: int = 30 * 60
    host_delay_s: float = 0.5
    host_penalty_cap: float = 16.0


DEFAULTS = Params()

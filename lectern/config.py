"""Parameters of the operators, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field

# The label names and default parameters users of the data products rely on.
POLARITY_LABELS = ("negative", "neutral", "positive")
WATCH_URL = "https://www.youtube.com/watch?v="
OUTLIER_TOPIC = -1


@dataclass(frozen=True)
class ChunkSettings:
    max_chars: int = 1000
    overlap: int = 100
    gap_seconds: float = 5.0


@dataclass(frozen=True)
class TopicSettings:
    dims: int = 64
    project_dims: int = 5
    # None: a fifth of the spread along the widest coordinate.
    cell_size: float | None = None
    # A topic has so large a share of all chunks, and so many at least.
    min_share: float = 0.005
    min_cluster_size: int = 5
    num_topics: int | None = None
    top_words: int = 10
    representative_docs: int = 3
    min_df: int = 2
    time_bins: int = 20
    label_count: int = 5
    dedup_ratio: float = 0.9


@dataclass(frozen=True)
class Settings:
    chunks: ChunkSettings = field(default_factory=ChunkSettings)
    topics: TopicSettings = field(default_factory=TopicSettings)
    embed_batch: int = 32
    score_batch: int = 8
    seed: int = 42

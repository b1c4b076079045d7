"""Settings of a build, with a TOML reader."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ingest:
    chunk_size: int = 2000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError(f"overlap {self.overlap} has to be below chunk_size {self.chunk_size}")

    @property
    def stride(self) -> int:
        return self.chunk_size - self.overlap


@dataclass(frozen=True)
class Scoring:
    max_n: int = 3
    min_occurrences: int = 10


@dataclass(frozen=True)
class Placement:
    k_neighbors: int = 5
    strength_threshold: float = 0.001
    max_concepts: int | None = None
    projection_seed: int = 42
    shard_radius: float = 0.9


@dataclass(frozen=True)
class Embedding:
    base_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"


@dataclass(frozen=True)
class Enrichment:
    base_url: str = "http://localhost:11434"
    summarize_model: str = "mistral"
    name_model: str = "mistral"
    max_chunks: int = 5
    signal_threshold: float = 0.5


@dataclass(frozen=True)
class Settings:
    """normalize: 'pooled' divides scores by the largest of all sources, 'per_source' by that of their own."""

    output_dir: str = "./concepts"
    max_concepts_per_source: int | None = 100
    normalize: str = "pooled"
    ingest: Ingest = field(default_factory=Ingest)
    scoring: Scoring = field(default_factory=Scoring)
    placement: Placement = field(default_factory=Placement)
    embedding: Embedding = field(default_factory=Embedding)
    enrichment: Enrichment = field(default_factory=Enrichment)


#: Section names of configuration files that differ from the fields here: fixed values.
_SECTIONS = {"tfidf": "scoring", "embed": "embedding", "enrich": "enrichment"}


def settings_from(text: str) -> Settings:
    """Settings from TOML; what is not given has its default, unknown names are an error. [placement.sharding] shard_radius is read too."""
    parts = {f.name: f for f in dataclasses.fields(Settings)}
    given: dict = {}
    for key, value in tomllib.loads(text).items():
        name = _SECTIONS.get(key, key)
        if name not in parts:
            raise ValueError(f"unknown setting {key}")
        if isinstance(value, dict):
            flat = {k: v for k, v in value.items() if not isinstance(v, dict)}
            for inner in (v for v in value.values() if isinstance(v, dict)):
                flat |= inner
            kind = type(getattr(Settings(), name))
            known = {f.name for f in dataclasses.fields(kind)}
            if set(flat) - known:
                raise ValueError(f"unknown settings {sorted(set(flat) - known)} in [{key}]")
            value = kind(**flat)
        given[name] = value
    return Settings(**given)

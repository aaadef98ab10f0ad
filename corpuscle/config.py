"""Settings with their defaults and the ranges that they must be in."""

from __future__ import annotations

from dataclasses import dataclass

from .operators.evaluate import CRITERIA

LEVELS = ("c0", "c1", "c2", "c3", "c4")


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 600
    chunk_overlap: int = 100
    gleaning_rounds: int = 2
    context_window: int = 8000
    max_levels: int = 3
    max_cluster_size: int = 10
    seed: int = 42
    min_entity_mentions: int = 1
    level: str = "c1"
    helpfulness_threshold: int = 0
    top_k: int = 10
    eval_runs: int = 5
    embedding_dim: int = 64
    attempts: int = 3
    concurrency: int = 20

    def __post_init__(self):
        ranges = {"chunk_size": (100, 2400), "chunk_overlap": (0, 300), "gleaning_rounds": (0, 5), "context_window": (1000, 128_000), "max_levels": (1, 5), "helpfulness_threshold": (0, 100), "top_k": (1, 100), "eval_runs": (1, 10), "concurrency": (1, 1000)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        if self.level not in LEVELS[: self.max_levels]:
            raise ValueError(f"level must be one of {LEVELS[: self.max_levels]}")


def checked_question(text: str) -> str:
    text = text.strip()
    if not 3 <= len(text) <= 2000:
        raise ValueError("a question has 3 to 2000 characters")
    return text


def checked_questions(texts: list[str]) -> list[str]:
    texts = [t.strip() for t in texts]
    if not 1 <= len(texts) <= 125 or any(len(t) < 10 for t in texts):
        raise ValueError("an evaluation has 1 to 125 questions of 10 characters at least")
    return texts


def checked_criteria(names: list[str] | None) -> tuple[str, ...]:
    """All criteria for none given; names in any case, each once."""
    if not names:
        return CRITERIA
    found = tuple(n.lower() for n in names)
    if len(set(found)) < len(found) or set(found) - set(CRITERIA):
        raise ValueError(f"criteria must be different ones of {CRITERIA}")
    return found

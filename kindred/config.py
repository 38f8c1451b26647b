"""Settings and ensemble weights, read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from kindred.functions.numbers import normalized_weights

# The tuned weights of vectors and n-grams.
DEFAULT_WEIGHTS = (0.8334, 0.1666)
#: The weights of the detailed graph, which has its own.
GRAPH_WEIGHTS = (0.7, 0.3)


@dataclass(frozen=True)
class Settings:
    """Where data lies and which thresholds hold; `from_environment` reads KINDRED_* variables."""

    dataset_path: str = ""
    threshold: float = 0.5
    z_score_threshold: float = -2.0
    idf_threshold: float = 0.0
    metric: str = "cosine"
    cache_seconds: int = 86_400
    weights: tuple[float, float] = field(default=DEFAULT_WEIGHTS)

    @classmethod
    def from_environment(cls) -> Settings:
        get, base = (lambda name, kind, or_: kind(os.environ.get(f"KINDRED_{name}", or_))), cls()
        return cls(get("DATASET", str, base.dataset_path), get("THRESHOLD", float, base.threshold), get("Z_SCORE", float, base.z_score_threshold), get("IDF", float, base.idf_threshold), get("METRIC", str, base.metric), get("CACHE_SECONDS", int, base.cache_seconds))


def weights_for(language: str, text: str | None) -> tuple[float, float]:
    """Weights of a language from a JSON text {"languages": {"ru": {"sbert_weight": .., "tfidf_weight": ..}}}; of
    `ru` if it has none, the default if neither has, scaled to sum 1."""
    languages = (json.loads(text).get("languages", {}) if text else {}) or {}
    own = languages.get(language) or languages.get("ru") or {}
    return normalized_weights(own.get("sbert_weight", DEFAULT_WEIGHTS[0]), own.get("tfidf_weight", DEFAULT_WEIGHTS[1]))

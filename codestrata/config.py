"""Options of all parts: environment over file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "CODESTRATA_"


@dataclass
class Config:
    search_limit: int = 5
    relevance_threshold: float = 0.3
    lexical_weight: float = 0.4
    semantic_weight: float = 0.6
    injection_threshold: float = 0.4
    max_tokens: int = 2000
    max_chunk_tokens: int = 500
    summary_similarity: float = 0.7
    embedding_dim: int = 384
    cycle_limit: int = 500
    batch_size: int = 32
    priority_hours: int = 24
    retry_attempts: int = 3
    hotspot_limit: int = 20


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Config:
    """``path`` names a YAML file (ignored if missing or not a mapping); variables are ``CODESTRATA_<OPTION>``.

    Values that do not fit the option's type are ignored.
    """
    env = os.environ if environment is None else environment
    layers: list[dict] = []
    if path and Path(path).is_file():
        try:
            import yaml

            data = yaml.safe_load(Path(path).read_text())
        except Exception:
            data = None
        layers.append(data if isinstance(data, dict) else {})
    layers.append({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})
    out = Config()
    for layer in layers:
        for f in fields(Config):
            if f.name in layer:
                try:
                    setattr(out, f.name, type(getattr(out, f.name))(layer[f.name]))
                except (TypeError, ValueError):
                    pass
    return out

"""Settings from the environment, with defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

LOG_LEVELS = ("fatal", "error", "warn", "info", "debug", "trace", "silent")
PROVIDERS = {"LLM_PROVIDER": ("rules",), "EMBEDDING_PROVIDER": ("deterministic",)}


class ConfigError(ValueError):
    """A variable has a value that cannot be used."""


@dataclass(frozen=True)
class Config:
    llm: str = "rules"
    embeddings: str = "deterministic"
    store: str = "tessera-store"
    log_level: str = "info"
    token: str | None = None
    port: int = 3000


def load(env: Mapping[str, str]) -> Config:
    """All wrong variables are named at once."""
    wrong = [f"{k} must be one of {', '.join(v)}" for k, v in PROVIDERS.items() if env.get(k, v[0]) not in v]
    if env.get("LOG_LEVEL", "info") not in LOG_LEVELS:
        wrong.append(f"LOG_LEVEL must be one of {', '.join(LOG_LEVELS)}")
    port = env.get("PORT", "3000")
    if not port.isdigit() or not int(port):
        wrong.append("PORT must be a positive number")
    wrong += [f"{k} must not be empty" for k in ("STORE_PATH", "GITHUB_TOKEN") if env.get(k) == ""]
    if wrong:
        raise ConfigError("; ".join(wrong))
    return Config(env.get("LLM_PROVIDER", "rules"), env.get("EMBEDDING_PROVIDER", "deterministic"), env.get("STORE_PATH", "tessera-store"), env.get("LOG_LEVEL", "info"), env.get("GITHUB_TOKEN"), int(port))

"""An investment thesis: the query that companies are scored against."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

from tessera.schemas import STAGES

SUM_TOLERANCE = 0.001
COMPONENTS = ["semantic", "momentum", "keywords", "recency"]


class ThesisError(ValueError):
    """The document is no valid thesis."""


@dataclass(frozen=True)
class Thesis:
    name: str
    description: str
    stages: tuple[str, ...]
    weights: dict[str, float]
    exclude_sectors: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    geos: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    anti_patterns: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        wrong = []
        if not self.name or not self.description:
            wrong.append("name and description must not be empty")
        if not self.stages:
            wrong.append("hard_filters.stages: at least one is needed")
        wrong += [f"hard_filters.stages: unknown stage {s!r}" for s in self.stages if s not in STAGES]
        if set(self.weights) != set(COMPONENTS):
            wrong.append(f"weights: exactly {', '.join(COMPONENTS)} are needed")
        elif any(not 0 <= w <= 1 for w in self.weights.values()):
            wrong.append("weights: each must lie between 0 and 1")
        elif abs(sum(self.weights.values()) - 1) > SUM_TOLERANCE:
            wrong.append(f"weights: they must sum to 1 (within {SUM_TOLERANCE})")
        if wrong:
            raise ThesisError("; ".join(wrong))

    @property
    def text(self) -> str:
        """What is embedded for the semantic component."""
        return f"{self.name}. {self.description}"


def _texts(section: dict, key: str, where: str) -> tuple[str, ...]:
    value = section.get(key)
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ThesisError(f"{where}{key}: a list of texts is needed")
    return tuple(value)


def parse(text: str) -> Thesis:
    """A thesis from YAML; unknown keys at the top are refused, nested ones ignored."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ThesisError(f"no valid YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ThesisError("a mapping is needed")
    known = {"name", "description", "hard_filters", "soft_preferences", "anti_patterns", "weights"}
    if set(raw) != known:
        raise ThesisError(f"keys missing or unknown: {', '.join(sorted(map(str, set(raw) ^ known)))}")
    if not all(isinstance(raw[k], dict) for k in ("hard_filters", "soft_preferences", "weights")):
        raise ThesisError("hard_filters, soft_preferences and weights must be mappings")
    if not all(isinstance(raw[k], str) for k in ("name", "description")):
        raise ThesisError("name and description must be texts")
    weights = {k: raw["weights"].get(k) for k in COMPONENTS}
    if not all(isinstance(w, (int, float)) and not isinstance(w, bool) for w in weights.values()):
        raise ThesisError("weights: numbers are needed")
    hard, soft = raw["hard_filters"], raw["soft_preferences"]
    return Thesis(
        raw["name"],
        raw["description"],
        _texts(hard, "stages", "hard_filters."),
        {k: float(w) for k, w in weights.items()},
        _texts(hard, "exclude_sectors", "hard_filters."),
        *(_texts(soft, k, "soft_preferences.") for k in ("sectors", "geos", "keywords")),
        _texts(raw, "anti_patterns", ""),
    )

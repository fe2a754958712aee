"""Plan-time settings: normalisation, thresholds and component weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.dictionary import AbbreviationRules

TYPES = ["generic_text", "address", "person_name", "company", "email", "phone", "id_code"]
AUTO = ("auto", "auto_detect", "autodetect")

# The weights of each type's components.
WEIGHT_PROFILES: dict[str, dict[str, float]] = {
    "generic_text": {"exact_normalized": 20.0, "token_sort": 20.0, "token_set": 15.0, "jaro_winkler": 20.0, "levenshtein": 15.0, "partial_match": 10.0},
    "address": {"house_number": 20.0, "street": 20.0, "locality": 15.0, "city_state": 15.0, "postal_code": 15.0, "token_similarity": 15.0},
    "person_name": {"first_name": 25.0, "last_name": 35.0, "token_order_sort": 25.0, "initials": 15.0},
    "company": {"core_brand": 45.0, "corporate_suffix": 15.0, "token_set": 20.0, "jaro_winkler": 20.0},
    "email": {"domain": 40.0, "local_part": 50.0, "exact_match": 10.0},
    "phone": {"digits_match": 70.0, "country_code": 15.0, "edit_distance": 15.0},
    "id_code": {"exact_clean": 70.0, "prefix_match": 15.0, "levenshtein": 15.0},
}


@dataclass(frozen=True)
class NormalizationSettings:
    """mode: conservative, standard or aggressive. category: which dictionary expands abbreviations (None: all)."""

    mode: str = "standard"
    case_sensitive: bool = False
    remove_punctuation: bool = True
    normalize_whitespace: bool = True
    expand_abbreviations: bool = True
    normalize_numbers: bool = True
    remove_accents: bool = True
    remove_stopwords: bool = False
    category: str | None = None
    rules: AbbreviationRules = field(default_factory=AbbreviationRules)


@dataclass(frozen=True)
class Thresholds:
    """Least scores of the statuses; below the last it is no match."""

    strong: float = 85.0
    likely: float = 70.0
    possible: float = 40.0
    weak: float = 20.0

    def __post_init__(self):
        if not self.strong >= self.likely >= self.possible >= self.weak:
            raise ValueError("thresholds must not rise from strong to weak")


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to 100 as they are, others scaled to it with two decimals; equal shares where there is nothing to scale."""
    total = sum(weights.values())
    if total <= 0:
        return dict.fromkeys(weights, 100.0 / max(len(weights), 1))
    off = abs(total - 100.0) >= 0.001
    return {name: round(w * 100.0 / total, 2) if off else w for name, w in weights.items()}


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def weights_for(kind: str, custom: dict[str, float] | None = None) -> dict[str, float]:
    """The profile of a type (generic text for unknown ones) with the custom numbers for its own components, scaled if there are any customs."""
    name = kind.lower() if kind.lower() in WEIGHT_PROFILES else "generic_text"
    profile = dict(WEIGHT_PROFILES[name])
    if not custom:
        return profile
    profile.update((c, float(custom[c])) for c in profile if _is_number(custom.get(c)))
    return normalize_weights(profile)

"""From component scores to a result: weighted score, status, confidence and explanation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import Thresholds
from ..functions.text import tokens

# The statuses, best first; the texts of summaries, here and in the matchers, are fixed values too.
STATUSES = ["Strong Match", "Likely Match", "Possible Match", "Weak Match", "No Match"]


_FIELDS = ["score", "score_raw", "status", "confidence", "matching_type"]
_EXPLAINED = ["original_a", "original_b", "normalized_a", "normalized_b", "matching_tokens", "tokens_only_in_a", "tokens_only_in_b", "component_scores", "applied_weights", "summary"]


def choose(branches: list[tuple[Column, Column]]) -> Column:
    """The result of the first condition that holds, field by field, so that unused fields are not computed."""
    def pick(get):
        out = F.when(branches[0][0], get(branches[0][1]))
        for condition, value in branches[1:]:
            out = out.when(condition, get(value))
        return out

    return F.struct(
        *[pick(lambda r, f=f: r[f]).alias(f) for f in _FIELDS],
        F.struct(*[pick(lambda r, f=f: r["explanation"][f]).alias(f) for f in _EXPLAINED]).alias("explanation"),
    )


def composite(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean by weight of the components that have a positive one, within 0 and 100."""
    used = [(components[k], w) for k, w in weights.items() if k in components and w > 0]
    if not used:
        return F.lit(0.0)
    total = sum(w / 100.0 for _, w in used)
    mean = reduce(lambda x, y: x + y, [c * (w / 100.0) for c, w in used]) / total
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean))


def status(score: Column, thresholds: Thresholds = Thresholds()) -> Column:
    """By the unrounded score."""
    t = thresholds
    return F.when(score >= t.strong, STATUSES[0]).when(score >= t.likely, STATUSES[1]).when(score >= t.possible, STATUSES[2]).when(score >= t.weak, STATUSES[3]).otherwise(STATUSES[4])


def confidence(score: Column, components: dict[str, Column]) -> Column:
    """High, Medium or Low by the unrounded score and how far the components lie apart."""
    if not components:
        return F.when((score >= 90) | (score <= 10), "High").otherwise("Medium")
    values = list(components.values())
    high = F.greatest(*values) if len(values) > 1 else values[0]
    spread = high - (F.least(*values) if len(values) > 1 else values[0])
    return (
        F.when(score >= 88, F.when(spread <= 25, "High").otherwise("Medium"))
        .when(score <= 20, F.when(high <= 35, "High").otherwise("Medium"))
        .when(score >= 60, "Medium")
        .otherwise(F.when(spread >= 40, "Low").otherwise("Medium"))
    )


def _rounded_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.round(v, 1) if isinstance(v, Column) else F.lit(round(float(v), 1)))])


def result(st, original_a: Column, original_b: Column, normalized_a: Column, normalized_b: Column, components: dict[str, Column], weights: dict[str, float],
           kind: str, thresholds: Thresholds = Thresholds(), summary: Column | None = None) -> Column:
    """The result struct; summary: what to say unless empty. Stages hold what is used more than once."""
    names = list(components)
    held = st.add(**{f"c{i}": components[k].cast("double") for i, k in enumerate(names)}, na=normalized_a, nb=normalized_b)
    components, (na, nb) = dict(zip(names, held)), held[len(names):]
    score, ta, tb = st.add(score=composite(components, weights), ta=F.array_distinct(tokens(na)), tb=F.array_distinct(tokens(nb)))
    (shared,) = st.add(shared=F.array_sort(F.array_intersect(ta, tb)))
    fallback = (
        F.when(score >= 90, F.concat(F.lit("High similarity across components with "), F.size(shared).cast("string"), F.lit(" shared tokens.")))
        .when(score >= 70, "Likely match with minor differences in wording or formatting.")
        .when(score >= 45, "Partial overlap detected; verify specific attributes.")
        .otherwise("Low similarity; strings differ significantly.")
    )
    text = fallback if summary is None else F.coalesce(F.nullif(summary, F.lit("")), fallback)
    return F.struct(
        F.round(score, 1).alias("score"), score.alias("score_raw"), status(score, thresholds).alias("status"), confidence(score, components).alias("confidence"), F.lit(kind).alias("matching_type"),
        F.struct(
            original_a.alias("original_a"), original_b.alias("original_b"), na.alias("normalized_a"), nb.alias("normalized_b"),
            shared.alias("matching_tokens"), F.array_sort(F.array_except(ta, tb)).alias("tokens_only_in_a"), F.array_sort(F.array_except(tb, ta)).alias("tokens_only_in_b"),
            _rounded_map(components).alias("component_scores"), _rounded_map(weights).alias("applied_weights"), text.alias("summary"),
        ).alias("explanation"),
    )

"""Matching plans over DataFrames: pairs, columns and weighted column pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import AUTO, TYPES, NormalizationSettings, Thresholds
from ..functions.text import clean
from ..operators import detect, scoring
from ..operators.matchers import MATCHERS, Options, empty_result
from ..operators.stages import Stages


@dataclass(frozen=True)
class ColumnPair:
    col_a: str
    col_b: str
    type: str = "auto"
    weight: float = 1.0


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def _matched(st: Stages, col_a: Column, col_b: Column, kind: str, options: Options) -> Column:
    """The result of two columns; in automatic mode each row goes to its own matcher.

    A matcher sees null for rows that are not its own, so its regexes and Python measures skip them: one pass, not one a type.
    """
    a, b = st.add(a=clean(col_a), b=clean(col_b))
    (some,) = st.add(some=(a != "") & (b != ""))
    if kind not in AUTO:
        kind = kind if kind in MATCHERS else "generic_text"
        va, vb = st.add(a=F.when(some, a), b=F.when(some, b))
        found = MATCHERS[kind](st, va, vb, options)
        return scoring.choose([(some, found), (F.lit(True), empty_result(a, b, options.thresholds))])
    (own,) = st.add(kind=F.when(some, detect.pair_type(a, b)))
    branches = [(~some, empty_result(a, b, options.thresholds))]
    for name in TYPES:
        va, vb = st.add(a=F.when(own == name, a), b=F.when(own == name, b))
        branches.append((own == name, MATCHERS[name](st, va, vb, options)))
    return scoring.choose(branches)


@lru_cache(maxsize=256)
def _plan(session: str, prefix: str, kind: str, settings: NormalizationSettings | None, weights: tuple | None, thresholds: Thresholds) -> tuple[Stages, Column]:
    """The columns of a match of `{prefix}a` and `{prefix}b`, and its result; made once for a session."""
    st = Stages(prefix)
    options = Options(settings, None if weights is None else dict(weights), thresholds)
    return st, _matched(st, F.col(f"{prefix}a"), F.col(f"{prefix}b"), kind, options)


def _planned(df: DataFrame, prefix: str, kind: str, settings, weights: dict | None, thresholds: Thresholds) -> tuple[Stages, Column]:
    return _plan(df.sparkSession.sparkContext.applicationId, prefix, kind.lower(), settings, None if weights is None else tuple(weights.items()), thresholds)


def match_columns(df: DataFrame, col_a: str, col_b: str, matching_type: str = "auto", settings: NormalizationSettings | None = None,
                  weights: dict[str, float] | None = None, thresholds: Thresholds = Thresholds(), per_row: bool = False) -> DataFrame:
    """df with `match`, the result of col_a and col_b in each row.

    matching_type auto or auto_detect is settled once for the job from the first values, unless per_row; another
    spelling of auto is settled row by row, and an unknown type is generic text. Thresholds hold for all types.
    """
    _need(df, col_a, col_b)
    kind = "auto" if per_row and matching_type.lower() in AUTO else detect.job_type(df, col_a, col_b, matching_type)
    st, found = _planned(df, "_pairwright_", kind, settings, weights, thresholds)
    return st.done(df, {"_pairwright_a": F.col(f"`{col_a}`"), "_pairwright_b": F.col(f"`{col_b}`")}, match=found)


def match_multi(df: DataFrame, pairs: list[ColumnPair], settings: NormalizationSettings | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """df with `match`: the weighted result of several column pairs, each typed by itself (`auto`: row by row).

    Pairs of the same two columns are one component, the last one's type and score; the components are the pairs' rounded scores.
    """
    if not pairs:
        raise ValueError("no column pairs")
    _need(df, *[c for p in pairs for c in (p.col_a, p.col_b)])
    total = sum(p.weight for p in pairs)
    shares = {f"{p.col_a} ↔ {p.col_b}": p.weight / total * 100.0 if total > 0 else 100.0 / len(pairs) for p in pairs}
    st, results, inputs = Stages("_pairwright_all_"), [], {}
    for i, p in enumerate(pairs):
        own, found = _planned(df, f"_pairwright_{i}_of_", p.type, settings, None, thresholds)
        st.take_in(own)
        inputs |= {f"_pairwright_{i}_of_a": F.col(f"`{p.col_a}`"), f"_pairwright_{i}_of_b": F.col(f"`{p.col_b}`")}
        st.noted[f"_pairwright_all_{i}_match"] = found, 1 + max(n for _, n in own.noted.values())
        results.append(F.col(f"_pairwright_all_{i}_match"))
    labels = [f"{p.col_a} ↔ {p.col_b}" for p in pairs]
    parts = {label: r["score"] for label, r in zip(labels, results)}

    def joined(side, named):
        return F.concat_ws(" | ", *[
            F.concat(F.lit(f"{getattr(p, 'col_' + side)}: " if named else ""), r["explanation"][("original_" if named else "normalized_") + side]) for p, r in zip(pairs, results)])

    said = F.concat_ws("; ", *[F.concat(F.lit(label + " ("), r["score"].cast("string"), F.lit("%)")) for label, r in zip(labels, results)])
    found = scoring.result(st, joined("a", True), joined("b", True), joined("a", False), joined("b", False), parts, shares, "multi_column", thresholds, said)
    return st.done(df, inputs, match=found)


def match_pair(spark: SparkSession, a: str | None, b: str | None, matching_type: str = "auto", settings: NormalizationSettings | None = None,
               weights: dict[str, float] | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The result of two values, by the plan that columns get."""
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return match_columns(df, "a", "b", matching_type, settings, weights, thresholds, per_row=True).select("match.*")

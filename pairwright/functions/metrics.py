"""String similarity from 0 to 100 as Column expressions.

For all but Jaccard: a null on either side is 0, equal strings are 100, and one empty side is 0. The measures that are made here
(Jaro, Jaro-Winkler, Damerau-Levenshtein) take time by the product of both lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import let, tokens


def _guarded(a: Column, b: Column, score: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 100.0).when((a == "") | (b == ""), 0.0).otherwise(score)


def exact(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & (a == b), 100.0).otherwise(0.0)


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return _guarded(a, b, (1 - F.levenshtein(a, b) / longest) * 100.0)


def _sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_sort(a: Column, b: Column) -> Column:
    both = F.struct(_sorted(a).alias("x"), _sorted(b).alias("y"))
    return _guarded(a, b, let(both, lambda s: levenshtein(s["x"], s["y"])))


def token_set(a: Column, b: Column) -> Column:
    """The best of three: shared tokens against each side, and the sides with their shared tokens first."""
    def joined(x):
        return F.array_join(F.array_sort(x), " ")

    def score(s):
        parts = F.struct(
            joined(F.array_intersect(s["x"], s["y"])).alias("i"),
            joined(F.array_except(s["x"], s["y"])).alias("p"),
            joined(F.array_except(s["y"], s["x"])).alias("q"),
        )
        sides = let(parts, lambda t: F.struct(
            t["i"].alias("i"), F.trim(F.concat_ws(" ", t["i"], t["p"])).alias("p"), F.trim(F.concat_ws(" ", t["i"], t["q"])).alias("q")))
        return let(sides, lambda t: F.greatest(
            F.when(t["i"] == "", 0.0).otherwise(levenshtein(t["i"], t["p"])),
            F.when(t["i"] == "", 0.0).otherwise(levenshtein(t["i"], t["q"])),
            levenshtein(t["p"], t["q"])))

    return _guarded(a, b, let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), score))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all; null counts as no tokens, and two empty sides are 100."""
    both = F.struct(F.array_distinct(tokens(F.coalesce(a, F.lit("")))).alias("x"), F.array_distinct(tokens(F.coalesce(b, F.lit("")))).alias("y"))
    return let(both, lambda s: F.when((F.size(s["x"]) == 0) & (F.size(s["y"]) == 0), 100.0).otherwise(
        F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])) * 100.0))


def partial(a: Column, b: Column) -> Column:
    """The best window of the longer string; a contained string is 100."""
    def score(s):
        return F.when(F.contains(s["l"], s["s"]), 100.0).otherwise(
            F.array_max(F.transform(F.sequence(F.lit(1), F.char_length(s["l"]) - s["n"] + 1), lambda i: (1 - F.levenshtein(s["s"], F.substring(s["l"], i, s["n"])) / s["n"]) * 100.0)))

    shorter = F.char_length(a) <= F.char_length(b)
    both = F.struct(F.when(shorter, a).otherwise(b).alias("s"), F.when(shorter, b).otherwise(a).alias("l"), F.least(F.char_length(a), F.char_length(b)).alias("n"))
    return _guarded(a, b, let(both, score))


def _grams(c: Column, n: int) -> Column:
    def cut(p):
        return F.when(F.char_length(p) < n, F.array(p)).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))))

    return let(F.concat(F.lit("^"), c, F.lit("$")), cut)


def ngram(a: Column, b: Column, n: int = 3) -> Column:
    """Dice coefficient of the distinct n-grams of the strings between ^ and $."""
    both = F.struct(_grams(a, n).alias("x"), _grams(b, n).alias("y"))
    return _guarded(a, b, let(both, lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / (F.size(s["x"]) + F.size(s["y"])) * 100.0))


# The rest has no built-in function: numpy over whole Arrow batches, in step for strings of like length.

def _codes(values: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.uint32)
    raw = "".join(v.ljust(width, "\0") for v in values).encode("utf-32-le", "surrogatepass")
    out[:] = np.frombuffer(raw, np.uint32).reshape(len(values), width)
    return out


def _by_length(a: pd.Series, b: pd.Series, measure) -> np.ndarray:
    """measure(codes a, lengths a, codes b, lengths b) over rows with two different non-empty strings."""
    out = np.zeros(len(a))
    known = a.notna().to_numpy() & b.notna().to_numpy()
    x, y = a.where(known, "").to_numpy(object), b.where(known, "").to_numpy(object)
    same = known & (x == y)
    out[same] = 100.0
    la, lb = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    todo = known & ~same & (la > 0) & (lb > 0)
    size = np.maximum(la, lb)
    low = 0
    while (todo & (size > low)).any():
        high = max(16, 2 * low)
        rows = np.flatnonzero(todo & (size > low) & (size <= high))
        step = max(1, 4_000_000 // (high * high))
        for i in range(0, len(rows), step):
            r = rows[i:i + step]
            wide = int(size[r].max())
            out[r] = measure(_codes(list(x[r]), wide), la[r], _codes(list(y[r]), wide), lb[r]) * 100.0
        low = high
    return out


def _jaro(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Matches within half the longer length less one, taken greedily; transpositions count a half each."""
    rows, width = np.arange(len(a)), b.shape[1]
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    places = np.arange(width)
    inside = places < lb[:, None]
    hit_a, hit_b = np.zeros(a.shape, np.bool_), np.zeros(b.shape, np.bool_)
    for i in range(int(la.max())):
        may = inside & ~hit_b & (b == a[:, i:i + 1]) & (np.abs(places - i) <= window[:, None]) & (i < la)[:, None]
        first = may.argmax(axis=1)
        found = may[rows, first]
        hit_a[found, i] = True
        hit_b[rows[found], first[found]] = True
    m = hit_a.sum(axis=1)
    in_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable"), axis=1)
    in_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable"), axis=1)
    swapped = ((in_a != in_b) & (places < m[:, None])).sum(axis=1)
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / la + m / lb + (m - swapped / 2.0) / some) / 3.0, 0.0)


def _jaro_winkler(weight: float):
    def measure(a, la, b, lb):
        jaro = _jaro(a, la, b, lb)
        limit = np.minimum(np.minimum(la, lb), 4)
        first = min(4, a.shape[1])
        alike = np.cumprod(a[:, :first] == b[:, :first], axis=1) * (np.arange(first) < limit[:, None])
        return np.clip(jaro + alike.sum(axis=1) * weight * (1.0 - jaro), 0.0, 1.0)

    return measure


def _osa(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edits with swaps of neighbours, no place edited twice, over the longer length."""
    n, width = b.shape
    before, last = None, np.tile(np.arange(width + 1), (n, 1))
    out = np.zeros(n)
    for i in range(1, int(la.max()) + 1):
        row = np.empty_like(last)
        row[:, 0] = i
        cost = (b != a[:, i - 1:i]).astype(last.dtype)
        base = np.minimum(last[:, 1:] + 1, last[:, :-1] + cost)
        if before is not None and width > 1:
            swap = (a[:, i - 1:i] == b[:, :-1]) & (a[:, i - 2:i - 1] == b[:, 1:])
            base[:, 1:] = np.where(swap, np.minimum(base[:, 1:], before[:, :-2] + 1), base[:, 1:])
        # insertions run along the row: the least of base and what came before, plus one a step
        steps = np.arange(1, width + 1)
        row[:, 1:] = np.minimum(np.minimum.accumulate(np.minimum(base - steps, i), axis=1) + steps, base)
        done = la == i
        out[done] = row[done, lb[done]]
        before, last = last, row
    return 1.0 - out / np.maximum(la, lb)


@F.pandas_udf(T.DoubleType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_by_length(a, b, _osa))


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_by_length(a, b, _jaro))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_by_length(a, b, _jaro_winkler(0.1)))


def jaro_winkler_with(weight: float):
    """Jaro-Winkler with another prefix weight."""
    return F.pandas_udf(lambda a, b: pd.Series(_by_length(a, b, _jaro_winkler(weight))), T.DoubleType())


METRICS = {
    "exact_match": exact, "levenshtein": levenshtein, "damerau_levenshtein": damerau_levenshtein, "jaro": jaro, "jaro_winkler": jaro_winkler,
    "token_sort": token_sort, "token_set": token_set, "jaccard": jaccard, "partial_match": partial, "ngram": ngram,
}


def all_metrics(a: Column, b: Column) -> Column:
    """A struct of all ten measures, to one decimal but for the exact one."""
    return F.struct(*[(f(a, b) if name == "exact_match" else F.round(f(a, b), 1)).alias(name) for name, f in METRICS.items()])


def register(spark) -> None:
    """Make the three measures without a built-in function known to SQL."""
    for name in ("damerau_levenshtein", "jaro", "jaro_winkler"):
        spark.udf.register(f"{name}_similarity", METRICS[name])

"""Named intermediate columns, so that an expression used often is computed once and plans stay small."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import normalize


class Stages:
    """Columns that build upon each other, noted by name and laid out over a DataFrame by done().

    Names follow from the prefix alone, so what is noted can be kept and laid out over other tables: making columns
    costs far more than laying them out. They go by what they use, one projection for all that need
    the same number of steps, since Spark analyses a plan anew at each projection.
    """

    def __init__(self, prefix: str = "_pairwright_"):
        self.prefix = prefix
        self.noted: dict[str, tuple[Column, int]] = {}
        self.normal_forms: dict[tuple, Column] = {}

    def add(self, **columns: Column) -> list[Column]:
        """Names the columns; what stands for each, in order."""
        added = []
        for k, v in columns.items():
            name = f"{self.prefix}{len(self.noted)}_{k}"
            used = re.findall(rf"{self.prefix}[0-9]+_\w+", str(v))
            self.noted[name] = v, 1 + max((self.noted[u][1] for u in used), default=0)
            added.append(F.col(name))
        return added

    def one(self, column: Column) -> Column:
        return self.add(x=column)[0]

    def normal(self, column: Column, settings=None) -> Column:
        """The normal form of a named column; the same one is noted but once."""
        key = str(column), settings
        if key not in self.normal_forms:
            self.normal_forms[key] = self.add(norm=normalize(column, settings))[0]
        return self.normal_forms[key]

    def take_in(self, other: Stages) -> None:
        """Notes another's columns too."""
        self.noted |= other.noted

    def done(self, df: DataFrame, inputs: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
        """df's columns and these, which replace such of the same name. inputs: what stands for names that noted columns use."""
        kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
        df = df.withColumns(inputs) if inputs else df
        for level in range(1, max((n for _, n in self.noted.values()), default=0) + 1):
            df = df.withColumns({name: c for name, (c, n) in self.noted.items() if n == level})
        return df.select(*kept, *[v.alias(k) for k, v in columns.items()])

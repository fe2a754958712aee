"""Matching over streams: scoring has no state, so a streaming DataFrame takes the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import AUTO
from ..plans.engine import match_columns


def match_stream(df: DataFrame, col_a: str, col_b: str, matching_type: str = "auto", **options) -> DataFrame:
    """df with `match`; automatic types are told row by row, as a stream has no first values to look at."""
    return match_columns(df, col_a, col_b, matching_type, per_row=matching_type.lower() in AUTO, **options)


def write_matches(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Append matches to Parquet exactly once; trigger as writeStream has it (availableNow=True by default)."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

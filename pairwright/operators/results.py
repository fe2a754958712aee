"""What is done with results: filters, order, pages, statistics and the export table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import scratch_path
from .scoring import STATUSES


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with numbers from 1 in its present order.

    The rows are written with their part and place first, so that both are what they are however often they are read; the parts' counts,
    a row a part, come to the driver and go back as a small table.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "rows")
    place = F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), place.alias("place")).write.parquet(path)
    rows, first, starts = spark.read.parquet(path), 0, []
    for r in sorted(rows.groupBy("place.part").agg(F.count(F.lit(1)).alias("n"), F.min("place.at").alias("at")).collect(), key=lambda r: r["part"]):
        starts.append((r["part"], first - r["at"] + 1))
        first += r["n"]
    shifts = spark.createDataFrame(starts, "part int, shift long")
    numbered = rows.join(F.broadcast(shifts), F.col("place.part") == F.col("part"))
    return numbered.select(*[F.col(f"row.`{c}`") for c in df.columns if c != name], (F.col("place.at") + F.col("shift")).alias(name))


def light(df: DataFrame, row_id: str = "row_id", match: str = "match") -> DataFrame:
    """Results without their explanations, which Catalyst then does not compute."""
    m = F.col(match)
    return df.select(
        F.col(row_id).alias("row_index"), m["score"].alias("score"), m["status"].alias("status"), m["confidence"].alias("confidence"), m["matching_type"].alias("matching_type"),
        m["explanation"]["original_a"].alias("original_a"), m["explanation"]["original_b"].alias("original_b"), m["explanation"]["summary"].alias("summary"))


def _where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the scores: pushed below, it would make Spark compute them twice."""
    return df.withColumn("_here", F.monotonically_increasing_id()).where(condition & (F.col("_here") >= 0)).drop("_here")


def by_status(df: DataFrame, status: str = "all") -> DataFrame:
    return df if status.lower() == "all" else _where(df, F.col("status") == status)


def by_min_score(df: DataFrame, least: float) -> DataFrame:
    return _where(df, F.col("score") >= least)


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows of which either value or the summary holds the query, without case."""
    q = F.lit(query.strip().lower())
    return df if not query.strip() else _where(df, F.contains(F.lower("original_a"), q) | F.contains(F.lower("original_b"), q) | F.contains(F.lower("summary"), q))


SORTS = {"row": "row_index", "score": "score", "val_a": "original_a", "val_b": "original_b", "status": "status"}


def sort(df: DataFrame, by: str = "score", descending: bool = True, collation: str | None = None) -> DataFrame:
    """In the order of a column, then of rows; a collation orders text as a locale does."""
    key: Column = F.col(SORTS[by])
    if collation and by in ("val_a", "val_b", "status"):
        key = F.collate(key, collation)
    return df.orderBy(key.desc() if descending else key.asc(), F.col("row_index"))


def page(df: DataFrame, number: int = 1, size: int = 50, total: int | None = None) -> DataFrame:
    """One page of an ordered table; a number out of range is the nearest page."""
    pages = max(1, -(-(df.count() if total is None else total) // size))
    return df.offset((min(max(number, 1), pages) - 1) * size).limit(size)


def explain_row(df: DataFrame, number: int, row_id: str = "row_id", match: str = "match") -> DataFrame:
    """The whole result of one row, from 1."""
    if number < 1:
        raise ValueError("rows are numbered from 1")
    return df.where(F.col(row_id) == number).select(F.col(row_id).alias("row_index"), f"{match}.*")


def statistics(df: DataFrame, match: str = "match") -> DataFrame:
    """One row: total, a count for each status, and the mean of the rounded scores (0 without rows)."""
    names = ["strong", "likely", "possible", "weak", "no_match"]
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(match)["status"] == s).alias(n) for s, n in zip(STATUSES, names)],
        F.coalesce(F.round(F.avg(F.col(match)["score"]), 1), F.lit(0.0)).alias("avg_score"),
    )


def type_frequency(df: DataFrame, kind: Column) -> DataFrame:
    """How many rows there are of each type, and their share."""
    counts = df.groupBy(kind.alias("matching_type")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("matching_type", "n", F.round(F.col("n") / F.col("total"), 2).alias("share"))


def export_table(df: DataFrame, col_a: str = "Column_A", col_b: str = "Column_B", row_id: str = "row_id", match: str = "match") -> DataFrame:
    """The twelve columns of an export; two columns of one name would hide each other and are refused."""
    if col_a == col_b:
        raise ValueError("the two columns must have different names in an export")
    m, e = F.col(match), F.col(match)["explanation"]
    return df.select(
        F.col(row_id).alias("Row"), e["original_a"].alias(f"Original_{col_a}"), e["original_b"].alias(f"Original_{col_b}"),
        e["normalized_a"].alias(f"Normalized_{col_a}"), e["normalized_b"].alias(f"Normalized_{col_b}"), m["score"].alias("Match_Score"),
        m["status"].alias("Match_Status"), m["confidence"].alias("Confidence"), m["matching_type"].alias("Match_Type"),
        F.array_join(e["matching_tokens"], ", ").alias("Matching_Tokens"), e["summary"].alias("Match_Summary"), F.to_json(e["component_scores"]).alias("Component_Scores"))

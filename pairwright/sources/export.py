"""Results as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import xlsx
from .scratch import write_file


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header. Parts are written in parallel; single makes one file of a table that one task can write."""
    out = table.coalesce(1) if single else table
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def _clear(spark: SparkSession, path: str) -> None:
    """Delete the file, or the folder of workbooks, that an earlier export left; any other folder is refused."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    if fs.getFileStatus(where).isDirectory():
        for s in fs.listStatus(where):
            if s.isDirectory() or not re.fullmatch(r"part-\d{5,}\.xlsx", s.getPath().getName()):
                raise ValueError(f"{path} is a folder that holds more than workbooks of an export")
    fs.delete(where, True)


def write_xlsx(table: DataFrame, path: str) -> None:
    """A workbook through Spark's file system; a table over a sheet's limit becomes a folder of workbooks, in its order."""
    for k, books, file in xlsx.workbooks_of(table):
        if k == 0:
            _clear(table.sparkSession, path)
        write_file(table.sparkSession, path if books == 1 else f"{path}/part-{k:05}.xlsx", file)


def export(table: DataFrame, path: str, format: str = "csv") -> str:
    """Write an export table to a path that the caller chooses; returns the path."""
    if format == "csv":
        write_csv(table, path)
    elif format == "xlsx":
        write_xlsx(table, path)
    else:
        raise ValueError(f"unknown export format {format!r}; csv or xlsx")
    return path

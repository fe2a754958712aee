"""File readers: CSV, JSON and Excel as tables of text."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import detect
from . import xlsx

EXTENSIONS = (".csv", ".xlsx", ".xls", ".json")


@dataclass(frozen=True)
class TableInfo:
    rows: int
    columns_count: int
    columns: list[str]
    preview: list[dict]


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))
        if not files:
            return b""
        where = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(where)
    try:
        size = int(min(n, fs.getFileStatus(where).getLen()))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def csv_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding, and whether a quoted value may go over line breaks.

    UTF-8 if all of the file, or of a folder's files, is, else ISO-8859-1, in which every byte is a character. A value with
    a line break leaves a line with an odd number of quotes. Lines are taken as they stand, in all parts by as many tasks
    as Spark reads them with; a line break is never within a UTF-8 character.
    """
    line = F.col("value")
    odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    seen = spark.read.text(path).select("value").agg(F.bool_or(~F.is_valid_utf8(line)).alias("other"), F.bool_or(odd).alias("odd")).first()
    return "ISO-8859-1" if seen["other"] else "UTF-8", bool(seen["odd"])


def _clean(df: DataFrame) -> DataFrame:
    """Names without outer blanks (repeats numbered), all values text, null as the empty text."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        c = str(c).strip()
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}.{seen[c] - 1}")
    df = df.toDF(*names)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])


def _complete(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _columns_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in one JSON object of columns, each an array or an object by row; None if the file holds something else.

    The object is parsed where it is read; only the columns' names come to the driver.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    named = whole.select(F.map_keys("m").alias("names"), F.forall(F.map_values("m"), lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))).alias("of_rows")).take(2)
    if len(named) != 1 or not named[0]["names"] or not named[0]["of_rows"]:
        return None
    names = list(dict.fromkeys(named[0]["names"]))
    by = {name: F.try_element_at("m", F.lit(name)) for name in names}
    columns = [F.when(F.startswith(F.ltrim(v), F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.map_values(F.from_json(v, "map<string,string>"))).alias(f"c{i}") for i, v in enumerate(by.values())]
    lists = whole.select(*columns)
    least = F.least(*[F.size(c) for c in lists.columns]) if len(names) > 1 else F.size("c0")
    at = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    return lists.select(F.inline(F.transform(at, lambda i: F.struct(*[F.get(F.col(f"c{k}"), i).alias(f"c{k}") for k in range(len(names))])))).toDF(*names)


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records (an array, or an object a line), or one object of columns."""
    head = _head(spark, path, 1 << 16).lstrip(b"\xef\xbb\xbf \t\r\n")
    read = spark.read.option("primitivesAsString", True)
    if not head.startswith(b"{"):
        return read.option("multiLine", head.startswith(b"[")).json(path)
    first, _, rest = head.partition(b"\n")
    if rest.strip() and _complete(first):  # an object a line
        return read.json(path)
    if rest.strip() or len(head) > 60_000 or _complete(first):  # one object over lines, or on one line
        table = _columns_of(spark, path)
        if table is not None:
            return table
    return read.option("multiLine", bool(rest.strip()) and not _complete(first)).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, JSON or Excel file as text columns; the extension tells the format."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        encoding, over_lines = csv_layout(spark, path)
        read = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", over_lines)
        return _clean(read.option("encoding", encoding).csv(path))
    if kind == ".json":
        return _clean(_read_json(spark, path))
    if kind == ".xlsx":
        return _clean(xlsx.read(spark, path))
    if kind == ".xls":
        raise ValueError("the binary .xls format has no reader here; save the file as .xlsx")
    raise ValueError(f"unsupported format {kind or path!r}; supported are {', '.join(EXTENSIONS)}")


def describe(df: DataFrame, rows: int = 5) -> TableInfo:
    """Row count, columns and the first rows."""
    return TableInfo(df.count(), len(df.columns), df.columns, [r.asDict() for r in df.limit(rows).collect()])


def load_table(spark: SparkSession, path: str, view: str) -> tuple[DataFrame, TableInfo, dict[str, tuple[str, float]]]:
    """Read a file, register it as a view, and tell each column's type by its name or its first 30 values."""
    df = read_table(spark, path)
    df.createOrReplaceTempView(view)
    heads = df.limit(30)
    return df, describe(df), {c: detect.column_type(heads, c) for c in df.columns}

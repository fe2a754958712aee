"""A place for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import tempfile
import uuid
from typing import IO

from pyspark.sql import SparkSession


_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared spark.checkpoint.dir; in a temporary folder where that is unset and all run on this machine.

    What is written there is deleted by clear_scratch(), or at exit.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pairwright-"))
        shared = "file://" + _own[0]
    _made.append((spark, f"{shared.rstrip('/')}/{uuid.uuid4().hex}"))
    return f"{_made[-1][1]}/{name}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete what was written to one scratch path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [m for m in _made if not (m[0] is spark and path.startswith(f"{m[1]}/"))]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what the session has written to scratch paths; tables that read it are then of no use."""
    for owner, path in [m for m in _made if m[0] is spark]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove((owner, path))


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        with contextlib.suppress(Exception):  # the session may have ended
            clear_scratch(spark)
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def write_file(spark: SparkSession, path: str, content: IO[bytes]) -> None:
    """An open file's rest to any store that Spark writes, a megabyte at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        while chunk := content.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in any store that Spark writes."""
    write_file(spark, path, io.BytesIO(content))

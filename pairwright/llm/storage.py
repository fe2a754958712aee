"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_dir: list[str] = []
#: Tables that are written and not yet discarded: the session owns them until release().
_held: dict[str, SparkSession] = {}
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder if it is unset on a local master."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="pairwright-"))
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pairwright-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as __) for what runs within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES for what runs within: a batch is held several times over, by JVM and worker."""
    return settings(spark, **{_BATCH_KEY.replace(".", "__"): str(BATCH_BYTES)})


def small_batches_from_now(spark: SparkSession) -> None:
    """The same for the rest of the session, for rows that are computed after the operator has returned; a smaller setting stays."""
    now = spark.conf.get(_BATCH_KEY).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder; returns the table read back, and its path.

    This cuts lineage: a lost executor costs a re-read, not a re-computation. An operator discards the tables that its
    result does not read; release() deletes the others once the results are used.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _held[path] = spark
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _held.pop(path, None)


def held_tables() -> list[str]:
    """Paths of the tables that are still there."""
    return list(_held)


def owner(operator):
    """Of the tables that the operator writes only those that its result reads outlive it."""
    @functools.wraps(operator)
    def run(*args, **named) -> DataFrame:
        before = set(_held)
        result = operator(*args, **named)
        files = result.inputFiles()
        for path in [p for p in _held if p not in before]:
            if not any(path.rsplit("/", 1)[-1] in f for f in files):
                discard(result.sparkSession, path)
        return result

    return run


def release(spark: SparkSession | None = None) -> None:
    """Delete all tables that are still held; results that read them are then of no use. Done at exit for what is left."""
    for path, owner in list(_held.items()):
        if spark is None or owner is spark:
            discard(owner, path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        release()
    for path in _own_dir:
        shutil.rmtree(path, ignore_errors=True)


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns that an operator is about to add (names compare without case)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def count_pieces(pieces: Column) -> Column:
    """How many words split() has parted: what stands before the first or after the last of them is no word."""
    empty = lambda p, i: F.when(F.element_at(p, i) == "", 1).otherwise(0)
    return (F.size(pieces) - empty(pieces, 1) - F.when(F.size(pieces) > 1, empty(pieces, -1)).otherwise(0)).cast("long")


def count_words(text: Column, between: str) -> Column:
    """How many words a regex parts; null has none. split() is ten times as fast as counting a regex's matches."""
    return F.transform(F.array(F.split(F.coalesce(text, F.lit("")), between)), count_pieces)[0]

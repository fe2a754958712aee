"""Sharding by a two-pass external shuffle.

Pass 1 scatters records over buckets of a bounded number of bytes by a seeded
hash of their place in the input. Pass 2 shuffles each bucket (Spark's shuffle() is a Fisher-Yates shuffle)
and writes it to the shared folder, one bucket in memory at a time. The written buckets, one after the other, are
one random order of all records; shards are equal runs of it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import materialize, owner, settings, without

#: Bytes in a bucket: 1 / MAX_BUCKETS of all, within these bounds.
LEAST_BYTES, MOST_BYTES, MAX_BUCKETS = 4_000_000, 256_000_000, 500_000
#: Partitions that the buckets are dealt over; each holds many buckets of a large table.
MAX_PARTITIONS = 50_000
#: A bucket-offset table of this many rows is at most 16 MB and may be broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_BUCKETS = 1_000_000
#: Buckets of which one running sum is made; their totals come to the driver.
GROUP = 1024


def _placed(df: DataFrame) -> tuple[DataFrame, Column]:
    """df and what tells its rows apart even if a task runs again: a file and a place in it, or a written number."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return df, F.struct("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return materialize(df.withColumn("_nth", F.monotonically_increasing_id()), "numbered")[0], F.col("_nth")


def scatter(df: DataFrame, buckets: int, seed: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """row (all columns of df as a struct), bucket and h, a hash of the row's place, id and text: pass 1."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # the input's columns go into a struct first, so none of them can clash
    df, place = _placed(df)
    h = F.xxhash64(F.lit(seed), place, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    dealt = df.select(F.struct(*columns).alias("row"), h.alias("h")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    return dealt.repartition(min(buckets, MAX_PARTITIONS), "bucket").sortWithinPartitions("bucket", "h")


def _starts(counts: DataFrame, buckets: int) -> DataFrame:
    """bucket and first: how many rows the buckets before it hold. Sums run within groups; only groups' totals meet on the driver."""
    grouped = counts.withColumn("group", F.floor(F.col("bucket") / GROUP).cast("int"))
    totals, first, rows = grouped.groupBy("group").agg(F.sum("n").alias("n")).collect(), 0, []
    for r in sorted(totals, key=lambda r: r["group"]):
        rows.append((r["group"], first))
        first += r["n"]
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0)))
    groups = counts.sparkSession.createDataFrame(rows, "group int, base long")
    starts = within.join(F.broadcast(groups), "group").select("bucket", (F.col("base") + F.col("within")).alias("first"))
    return F.broadcast(starts) if buckets <= MAX_BROADCAST_BUCKETS else starts


@owner
def shard(df: DataFrame, n_shards: int = 16, seed: int = 20240, text_col: str = "text", id_col: str = "doc_id",
          bucket_bytes: int | None = None) -> DataFrame:
    """All rows and columns of df, and shard int, slot long (its place in the shard, from 0).

    Law `rows`: shards differ by one row at most. The hash takes a row's place in the input too, so that
    neither a null or repeated id nor copies, even rows equal in all columns, make a bucket hot. A null text counts no bytes, a text of any length is one record, an empty
    table gives no rows, input columns named shard or slot are replaced. An input that is not a plain scan of files is written first. Runs over the same
    files, or the same partitions, repeat the same order; a repeated task rewrites its whole buckets, so no row is lost or doubled.
    """
    df = without(df, ["shard", "slot"])
    spark = df.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 64
    total = int(df.agg(F.sum(size).alias("n")).first()["n"] or 0)
    buckets = max(1, -(-total // (bucket_bytes or min(max(LEAST_BYTES, total // MAX_BUCKETS), MOST_BYTES))))
    shuffled = (
        scatter(df, buckets, seed, text_col, id_col).groupBy("bucket")
        .agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
    )
    # sorted input and an aggregation by sort: one bucket is in memory at a time
    with settings(spark, spark__sql__execution__useObjectHashAggregateExec="false"):
        written, _ = materialize(shuffled, "buckets")
    counts, _ = materialize(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    # shard s holds the places from ceil(s * rows / n) on
    return (
        written.join(_starts(counts, buckets), "bucket")
        .withColumn("place", (F.col("first") + F.col("pos")).cast("long"))
        .withColumn("to", F.expr(f"(place * {n_shards}L) div {max(rows, 1)}L"))
        .withColumn("start", F.expr(f"(to * {max(rows, 1)}L + {n_shards - 1}L) div {n_shards}L"))
        .select("row.*", F.col("to").cast("int").alias("shard"), (F.col("place") - F.col("start")).alias("slot"))
    )


def digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The contract's columns of shard() over documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs.select("doc_id", "text"), n_shards).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

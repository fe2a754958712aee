"""Near-duplicate embeddings by cross-polytope hashing.

Distinct vectors are rotated by seeded sign flips and fast Hadamard transforms; the largest coordinate by
magnitude, with its sign, names a vertex of the cross-polytope, and some such vertices a
bucket of a table. Each vector is in its own bucket and in the likeliest others (multiprobe).
Buckets of two and more are cut into chunks of bounded size, compared as matrix products chunk by
chunk, so a large bucket is many bounded tasks. A pair counts once: in the first bucket in which it meets.
How many vertices make a bucket follows from the largest label's count, and how many tables there are from that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import connected
from .storage import discard, materialize, owner

PROBES = 4
#: Tables for so many vertices a bucket. At cosine 0.98 and 64 dimensions a table misses 2, 8, 17 and 28 pairs in 100, and all
#: tables together about one in 10**8.
TABLES = {2: 5, 3: 7, 4: 10, 5: 14}
#: Vectors of the largest label for each bucket of a table at most: where more would meet by chance, buckets get one vertex more.
PER_BUCKET = 0.07
#: Vectors in a chunk, about; two chunks meet in one task.
CHUNK = 512
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row (a power of two wide)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _width(dim: int) -> int:
    return max(2, 1 << max(0, dim - 1).bit_length())


def layout(n: int, dim: int) -> int:
    """How many vertices make a bucket where a label has n vectors of dim components."""
    return next((k for k in TABLES if PER_BUCKET * (2 * _width(dim)) ** k >= n), max(TABLES))


def bucket_keys(vectors: np.ndarray, vertices: int) -> np.ndarray:
    """rows x tables x PROBES bucket numbers; the first is the vector's own bucket.

    A probe changes one vertex, to the second or third largest coordinate; those with the least loss of magnitude are taken.
    """
    dim, tables = vectors.shape[1], TABLES[vertices]
    wide = _width(dim)
    padded = np.zeros((len(vectors), wide))
    padded[:, :dim] = vectors
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(vectors), tables, PROBES), np.int64)
    rows = np.arange(len(vectors))
    ranks = min(3, wide)
    for t in range(tables):
        choice, gaps = [], []
        for _ in range(vertices):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], wide))
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :ranks]
            value = x[rows[:, None], order]
            choice.append(2 * order + (value < 0))
            gaps.append(np.abs(value[:, :1]) - np.abs(value))

        def key(parts):
            return sum(p.astype(np.int64) * (2 * wide) ** i for i, p in enumerate(parts))

        own = [c[:, 0] for c in choice]
        out[:, t, 0] = key(own)
        swaps = [(f, rank) for f in range(vertices) for rank in range(1, ranks)]
        loss = np.array([gaps[f][:, rank] for f, rank in swaps])
        others = np.array([key([choice[f][:, rank] if i == f else own[i] for i in range(vertices)]) for f, rank in swaps])
        best = np.argsort(loss, axis=0, kind="stable")
        for p in range(1, PROBES):
            out[:, t, p] = others[best[min(p, len(swaps)) - 1], rows]
    return out


def _with_keys(most: int):
    """Rows that end in an embedding in; codes (bucket number * tables + table) added. most: vectors of the largest label."""
    def run(batches):
        for batch in batches:
            flat = batch.column(batch.num_columns - 1)
            starts = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for dim in np.unique(sizes):
                pick, vertices = np.flatnonzero(sizes == dim), layout(most, int(dim))
                tables = TABLES[vertices]
                for at in range(0, len(pick), 2000):
                    some = pick[at:at + 2000]
                    x = values[starts[:-1][some][:, None] + np.arange(dim)].astype(np.float64)
                    codes = bucket_keys(_units(x), vertices) * tables + np.arange(tables)[None, :, None]
                    own = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (tables * PROBES)), pa.array(codes.ravel()))], [*own.schema.names, "codes"])

    return run


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric boolean matrix."""
    root, todo = np.arange(len(linked)), np.ones(len(linked), np.bool_)
    for i in range(len(linked)):
        if todo[i]:
            front = np.array([i])
            while len(front):
                root[front], todo[front] = i, False
                front = np.flatnonzero(linked[front].any(axis=0) & todo)
    return root


def _side(cell):
    s = cell.values
    n = len(s)
    return s.field("id").to_numpy(), s.field("copies").to_numpy(), _units(s.field("embedding").flatten().to_numpy().reshape(n, -1).astype(np.float64)), s.field("codes").flatten().to_numpy().reshape(n, -1, PROBES)


def _compare(least: float):
    """Tasks (code, a, b) of one chunk, or two of a bucket, in; rows (u, v, n): u has n links here and is connected to v."""
    def run(batches):
        for batch in batches:
            for code, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                same = not b.is_valid
                x = _side(a)
                table = code % x[3].shape[1]
                y = x if same else _side(b)
                i, j = np.nonzero(x[2] @ y[2].T >= least)
                if same:
                    i, j = i[i < j], j[i < j]
                for s in range(table):
                    apart = ~(x[3][i, s][:, :, None] == y[3][j, s][:, None, :]).any(axis=(1, 2))
                    i, j = i[apart], j[apart]
                own = x[3][i, table]
                both = (own[:, :, None] == y[3][j, table][:, None, :]).any(axis=2)
                here = np.where(both, own, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == code
                i, j = i[here], j[here]
                if not len(i):
                    continue
                if same:
                    ids, copies = x[0], x[1]
                else:
                    ids, copies, j = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), j + len(x[0])
                n = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
                linked = np.zeros((len(ids), len(ids)), np.bool_)
                linked[i, j] = linked[j, i] = True
                root, has = _roots(linked), np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root[has]]), pa.array(n[has].astype(np.int64))], ["u", "v", "n"])

    return run


@owner
def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors of its label with cosine >= least), component_id and kept for each row; no other columns.

    Equal vectors of a label are compared once and counted as often as they occur. Rows without id or label, and
    vectors that are null, empty, zero or hold a null or non-finite component, link with nothing, as do vectors of
    different lengths. A row that repeats an id, in its label or another, is one more vector with links of its own.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows, _ = materialize(rows.withColumn("sound", sound).withColumn("embedding", F.when(F.col("sound"), F.col("embedding"))), "vectors")
    most = rows.where("sound").groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    # a group is the equal vectors of a label; its number is fixed when it is written
    groups = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = groups.select(F.monotonically_increasing_id().alias("id"), "label", "least", "copies", "embedding")
    signed, signed_path = materialize(groups.mapInArrow(_with_keys(most), _schema(groups)), "signed")

    bucket = ["label", "dim", "code"]
    member = signed.select("id", "label", F.size("embedding").alias("dim"), F.explode(F.array_distinct("codes")).alias("code"))
    shared = member.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = member.join(shared, bucket).withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    full = member.join(signed.select("id", "copies", "embedding", "codes"), "id")
    chunks, chunks_path = materialize(full.groupBy(*bucket, "chunks", "chunk").agg(F.collect_list(F.struct("id", "copies", "embedding", "codes")).alias("members")), "chunks")
    alone = chunks.select("code", F.col("members").alias("a"), F.lit(None).cast(chunks.schema["members"].dataType).alias("b"))
    others = chunks.where("chunk + 1 < chunks").select(*bucket, F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"), F.col("members").alias("a"))
    met = others.join(chunks.select(*bucket, "chunk", F.col("members").alias("b")), [*bucket, "chunk"]).select("code", "a", "b")
    found, found_path = materialize(alone.union(met).mapInArrow(_compare(least), "u long, v long, n long"), "found")

    parts = connected(found.select("u", "v")).select(F.col("node").alias("id"), "component")
    links = found.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    own = signed.select("id", "label", "embedding", "copies", "least").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own, _ = materialize(own, "linked")
    # the smallest vec_id of a component of two groups or more
    first = own.where("n is not null").groupBy("component").agg(F.min("least").alias("first"))
    known = own.join(first, "component", "left").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    good = rows.where("sound").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(spark, signed_path, chunks_path, found_path)
    return materialize(good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "classes")[0]


def _schema(groups: DataFrame):
    return T.StructType([*groups.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])


def digest(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)

"""Near-duplicate documents by MinHash.

Each distinct shingle set is signed by BANDS * ROWS universal hash minima. Documents that share a
band are candidates; candidates are checked on short signatures, then on their full shingle sets;
confirmed links go to connected components.

Within a bucket, members are first linked to one centre, so a bucket of n documents makes n pairs. Members whose
components are then still apart are compared in full, so that no link is lost to the short cut: buckets are cut
into chunks of bounded size that meet two by two, and a task gives the links that join components, not the
pairs it looks at. Pairs already in one component are never compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytescan as B
from .components import connected
from .storage import discard, materialize, owner

BANDS, ROWS = 24, 5
#: Documents, and shingles, in a chunk, about.
CHUNK_ROWS, CHUNK_SHINGLES = 512, 50_000
SEED = 41
#: Tables of up to so many narrow rows (16 to 32 MB) are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000
SIGN_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary"
SET_SCHEMA = "doc_id long, n_shingles long, bands array<long>, signature binary, shingles binary"


def least_agreeing(percent: int) -> int:
    """So many one-byte minima agree at least in all but one of 10**9 pairs of this similarity."""
    n, p, left = BANDS * ROWS, percent / 100, 0.0
    for k in range(n):
        left += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if left > 1e-9:
            return k
    return n


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x hashes: the least value of each multiply-shift hash over a text's shingles."""
    factor, addend = _hash_family()
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(factor), len(offsets) - 1), np.uint32)
    if len(full):
        at, value = offsets[:-1][full], np.empty(len(sets), np.uint64)
        for i in range(len(factor)):
            np.multiply(sets, factor[i], out=value)
            value += addend[i]
            value >>= np.uint64(32)
            out[i, full] = np.minimum.reduceat(value.astype(np.uint32), at)
    return out.T


def _signs(batches, columns):
    """The named columns for each text of rows doc_id, text."""
    B.claim("minhash")
    for batch in B.slices(batches, max_bytes=1_000_000):
        data, at = B.buffer_of(batch.column(1))
        sets, offsets = B.shingle_sets(B.Words(B.LOWER[data], at))
        low = minima(sets, offsets)
        made = {"doc_id": lambda: batch.column(0), "n_shingles": lambda: pa.array(np.diff(offsets)), "signature": lambda: pa.array([row.tobytes() for row in low.astype(np.uint8)], pa.binary()),
                "bands": lambda: _bands(low), "h1": lambda: _sums(B.mix(sets + np.uint64(0x1234567)), offsets), "h2": lambda: _sums(B.mix(sets ^ np.uint64(0x5DEECE66D)), offsets),
                "shingles": lambda: pa.array([sets[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], pa.binary())}
        yield pa.RecordBatch.from_arrays([made[c]() for c in columns], columns)


def _bands(low: np.ndarray) -> pa.Array:
    band = np.zeros((len(low), BANDS), np.uint64)
    for r in range(ROWS):
        band = B.mix(band * np.uint64(31) + low[:, r::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(1 << 33))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))


def _sums(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))


def _signed(docs: DataFrame, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(lambda batches: _signs(batches, names), schema)


def _confirm(percent: int):
    def run(batches):
        for part in B.slices(batches, "text_a"):
            left, right = (B.shingle_sets(B.Words(B.LOWER[(got := B.buffer_of(part.column(part.schema.get_field_index(c))))[0]], got[1])) for c in ("text_a", "text_b"))
            linked = np.array([_linked(left[0][left[1][i]:left[1][i + 1]], right[0][right[1][i]:right[1][i + 1]], percent) for i in range(part.num_rows)], np.bool_)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], ["u", "v"])

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many minima agree, for each row of x with each of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(x.shape[1]):
        out += x[:, k][:, None] == y[:, k][None, :]
    return out


def _side(cell) -> dict:
    s = cell.values
    n = len(s)
    sign = np.frombuffer(b"".join(s.field("signature").to_pylist()), np.uint8).reshape(n, -1)
    return {"id": s.field("doc_id").to_numpy(), "part": s.field("part").to_numpy(), "n": s.field("n_shingles").to_numpy(), "sign": sign,
            "bands": s.field("bands").flatten().to_numpy().reshape(n, -1), "cell": s}


def _apart(band: int, x: dict, y: dict, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be linked, are in two components, and meet in this bucket first."""
    may = _agreement(x["sign"], y["sign"]) >= least_agreeing(percent)
    may &= x["part"][:, None] != y["part"][None, :]
    i, j = np.nonzero(may)
    if same:
        i, j = i[i < j], j[i < j]
    small, large = np.minimum(x["n"][i], y["n"][j]), np.maximum(x["n"][i], y["n"][j])
    like = 100 * small >= percent * large
    i, j = i[like], j[like]
    for at in range(0, len(i), 100_000):
        p, q = i[at:at + 100_000], j[at:at + 100_000]
        common = x["bands"][p] == y["bands"][q]
        first = x["bands"][p, common.argmax(axis=1)] == band
        i[at:at + 100_000], j[at:at + 100_000] = np.where(first, p, -1), np.where(first, q, -1)
    return i[i >= 0], j[j >= 0]


def _tasks(batches):
    for batch in batches:
        for band, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            x = _side(a)
            yield band, x, (_side(b) if b.is_valid else x), not b.is_valid


def _candidates(percent: int):
    """Tasks of chunks in; (band, doc_id) of members that may be linked to another component here."""
    def run(batches):
        for band, x, y, same in _tasks(batches):
            i, j = _apart(band, x, y, same, percent)
            ids = np.unique(np.concatenate([x["id"][i], y["id"][j]]))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), band)), pa.array(ids)], ["band", "doc_id"])

    return run


def _joining(percent: int):
    """Tasks of chunks with shingle sets in; links that join components, a forest for each task."""
    def run(batches):
        for band, x, y, same in _tasks(batches):
            i, j = _apart(band, x, y, same, percent)
            if not len(i):
                continue
            parent: dict[int, int] = {}

            def root(p):
                while parent.get(p, p) != p:
                    p = parent[p]
                return p

            xs, ys = ([np.frombuffer(v, np.uint64) for v in side["cell"].field("shingles").to_pylist()] for side in (x, y))
            found = []
            for p, q in zip(i.tolist(), j.tolist()):
                a, b = root(int(x["part"][p])), root(int(y["part"][q]))
                if a != b and _linked(xs[p], ys[q], percent):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(x["id"][p]), int(y["id"][q])))
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _small(df: DataFrame, n: int) -> DataFrame:
    """df of n narrow rows, to be broadcast if they are few."""
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df


def _chunk_tasks(members: DataFrame, whole: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """band, a, b: each chunk of a bucket by itself (b null) and each two of them, and the table that holds them. whole: band and its number of chunks."""
    dealt = members.join(_small(whole, whole.count()), "band").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    chunks, path = materialize(dealt.groupBy("band", "chunks", "chunk").agg(F.collect_list(F.struct(*columns)).alias("a")), "chunks")
    alone = chunks.select("band", "a", F.lit(None).cast(chunks.schema["a"].dataType).alias("b"))
    first = chunks.where("chunk + 1 < chunks").select("band", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"), "a")
    return alone.union(first.join(chunks.where("chunks > 1").select("band", "chunk", F.col("a").alias("b")), ["band", "chunk"]).select("band", "a", "b")), path


def _star_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of documents with the centres of their buckets, as a written table (u, v)."""
    spark = docs.sparkSession
    signs = reps.select("doc_id", "signature", "n_shingles")
    pairs = buckets.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    agree = F.aggregate(
        F.sequence(F.lit(1), F.lit(BANDS * ROWS)), F.lit(0),
        lambda acc, i: acc + (F.substring(F.col("sa"), i, F.lit(1)) == F.substring(F.col("sb"), i, F.lit(1))).cast("int"),
    )
    likely = (
        pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
        .join(signs.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (agree >= least_agreeing(percent)))
        .select("a", "b")
    )
    likely, pairs_path = materialize(likely, "pairs")
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts, texts_path = materialize(docs.join(_small(ids, 2 * likely.count()), "doc_id", "left_semi"), "texts")
    both = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links, _ = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "u long, v long"), "confirmed")
    discard(spark, pairs_path, texts_path)
    return links


def _rest_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, enough of them to join all that are linked."""
    part = parts.select(F.col("node").alias("doc_id"), "component")
    part = _small(part, part.count())
    held = buckets.join(part, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    split = held.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q")
    split, split_path = materialize(split.select("band", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks")), "open")
    own = ["doc_id", "part", "n_shingles", "signature", "bands"]
    members = held.join(_small(split.select("band"), split.count()), "band").join(reps, "doc_id").select("band", *own)
    tasks, tasks_path = _chunk_tasks(members, split, own)
    may, may_path = materialize(tasks.mapInArrow(_candidates(percent), "band long, doc_id long").distinct(), "candidates")
    discard(docs.sparkSession, tasks_path)
    n = may.count()
    sets, sets_path = materialize(_signed(docs.join(_small(may.select("doc_id").distinct(), n), "doc_id", "left_semi"), SET_SCHEMA), "sets")
    full = sets.join(_small(may, n), "doc_id").join(part, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    whole, whole_path = materialize(full.groupBy("band").agg(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES).alias("chunks")), "sizes")
    tasks, tasks_path = _chunk_tasks(full.select("band", *own, "shingles"), whole, [*own, "shingles"])
    links, _ = materialize(tasks.mapInArrow(_joining(percent), "u long, v long"), "joining")
    discard(docs.sparkSession, split_path, whole_path, may_path, sets_path, tasks_path)
    return links


@owner
def near_duplicates(df: DataFrame, percent: int = 85, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept for each row of df; no other columns.

    Linked: five-word shingle sets with 100 * intersection >= percent * union. Texts without words are linked with
    nothing. Rows that repeat an id are one document, linked as any of them is; a row without id has
    component null, links with nothing and is kept. percent from 80 on: below, the bands would miss links.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed, signed_path = materialize(_signed(docs, SIGN_SCHEMA), "signed")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    key = ["n_shingles", "h1", "h2"]
    copies, copies_path = materialize(signed.where(~alone).groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*key, "least"), "copies")
    rep = F.when(~alone, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    rows = signed.join(_small(copies, copies.count()), key, "left").withColumn("rep", rep)
    own = F.coalesce(~alone & (F.col("rep") == F.col("doc_id")), F.lit(False))
    rows, _ = materialize(rows.select("doc_id", "n_shingles", "rep", own.alias("is_rep"), F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("signature")).alias("signature")), "members")
    reps = rows.where("is_rep").select("doc_id", "n_shingles", "bands", "signature")

    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other")).where("centre <> other").select("band", "centre")
    buckets, buckets_path = materialize(banded.join(shared, "band"), "buckets")
    found = _star_links(docs, reps, buckets, percent)
    parts = connected(found)
    rest = _rest_links(docs, reps, buckets, parts, percent)
    if rest.limit(1).count():
        parts = connected(found.union(rest))
    discard(spark, buckets_path, signed_path, copies_path)
    own = F.coalesce("component", "rep")
    result = (
        rows.join(_small(parts.select(F.col("node").alias("rep"), "component"), parts.count()), "rep", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    )
    return materialize(result, "classes")[0]


@owner
def deduplicate(df: DataFrame, percent: int = 85, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near_duplicates(), with all columns of df.

    Each row goes or stays by its own text: where an id repeats with different texts, each of them counts as a document
    (by a 64-bit hash of id and text in place of the id). Of rows equal in id and text one stays, any of them. Rows
    without id stay.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    own = F.col(f"`{id_col}`").cast("long")
    repeated, path = materialize(df.where(own.isNotNull()).groupBy(own.alias("_dedup_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_dedup_id"), "repeated")
    rows, n = df.select(*columns, own.alias("_dedup_id")), repeated.count()
    if n:
        again = rows.join(_small(repeated, n), "_dedup_id", "left_semi").dropDuplicates(["_dedup_id", text_col])
        again, _ = materialize(again.select(*columns, F.xxhash64("_dedup_id", F.col(f"`{text_col}`")).alias("_dedup_id")), "again")
        rows = rows.join(_small(repeated, n), "_dedup_id", "left_anti").select(*columns, "_dedup_id").unionByName(again)
    else:
        discard(df.sparkSession, path)
    gone = near_duplicates(rows, percent, text_col, "_dedup_id").where(~F.col("kept")).select(F.col("doc_id").alias("_dedup_id")).distinct()
    return rows.join(gone, "_dedup_id", "left_anti").select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)

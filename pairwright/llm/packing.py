"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces below the capacity are dealt over blocks of about BLOCK pieces. Each block evolves on several islands: a
solution is a grouping of pieces into bins. Crossover injects whole well-filled bins of one parent into the other, drops
the bins that hold the same pieces, and best-fits the displaced pieces: first one by one, then set by set, where an
open bin and a window of displaced pieces are filled anew by the set that leaves the least room. Fewer bins are fitter,
then fuller ones, so the room gathers in few bins until one bin less will do. After each epoch an island's best
solutions migrate to the next. A second round does the same with all pieces that the blocks left in bins that are not full.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytescan as B
from .storage import discard, materialize, owner
from .tokens import WordTokenizer

BLOCK = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION, CHILDREN, MIGRANTS = 3, 2, 12, 4, 3, 1
#: One in so many well-filled bins of a parent is injected; pieces that are tried together when an open bin is filled anew.
INJECTED, WINDOW = 32, 24
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_tokenizers: dict[str, WordTokenizer] = {}
B.keeps("packing", _tokenizers.clear)


def _worker_tokenizer(path: str) -> WordTokenizer:
    B.claim("packing")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """PIECES of each row: its ids and then `end`, cut every `capacity` ids. A null text is empty.

    ids_crc32 is over little-endian 32-bit ids; salt numbers the pieces of a partition.
    """
    where = path or default_tokenizer()

    def run(batches):
        tokenizer, salt = _worker_tokenizer(where), 0
        for batch in B.slices(batches):
            ids, offsets = tokenizer.encode(batch.column(1), end)
            ids = np.ascontiguousarray(ids, "<u4")
            counts = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(offsets)[row] - start)
            at, view = offsets[:-1][row] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt + np.arange(len(row)), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            salt += len(row)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


class _Bins:
    """Open bins by free space; best fit takes the least free space that holds a piece."""

    def __init__(self, capacity: int, n: int, free: list[int] | None = None, ids: list[int] | None = None):
        self.capacity, self.n = capacity, n
        self.open = sorted(zip(free or [], ids or []))

    def put(self, length: int) -> int:
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            free, bin_ = self.open.pop(at)
        else:
            free, bin_ = self.capacity, self.n
            self.n += 1
        if free > length:
            insort(self.open, (free - length, bin_))
        return bin_


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, put in this order."""
    bins, out = _Bins(capacity, 0), np.empty(len(lengths), np.int32)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        out[i] = bins.put(n)
    return out


def fitness(solution: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then a larger mean of squared fills."""
    fill = np.bincount(solution, weights=lengths) / capacity
    fill = fill[fill > 0]
    return -len(fill), float(np.mean(fill**2)) if len(fill) else 0.0


def settled(solution: np.ndarray, lengths: np.ndarray, capacity: int) -> bool:
    """Whether no grouping is better: as few bins as the sum needs, and all but one of them full."""
    fill = np.bincount(solution, weights=lengths)
    return np.count_nonzero(fill) <= -(-int(lengths.sum()) // capacity) and np.count_nonzero((fill > 0) & (fill < capacity)) <= 1


def _renumbered(solution: np.ndarray) -> np.ndarray:
    return np.unique(solution, return_inverse=True)[1].astype(np.int32)


def best_set(sizes: list[int], room: int) -> list[int]:
    """Numbers of the sizes with the largest sum within room; with sizes in falling order large ones are preferred.

    Bit k of `reach` tells whether some of the sizes so far sum to k.
    """
    reach, before, mask = 1, [], (1 << (room + 1)) - 1
    for n in sizes:
        before.append(reach)
        reach |= (reach << n) & mask
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for i in range(len(before) - 1, -1, -1):
        if not before[i] >> total & 1:
            out.append(i)
            total -= sizes[i]
    return out


def refit(solution: np.ndarray, lengths: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """The solution with its open bins filled anew, in place.

    The pieces of the emptiest bins are displaced. Every other open bin, fullest first, takes the best set of its own and
    a window of the displaced pieces if that is fuller than it was; what it gives up is displaced in turn. The
    displaced pieces are then put into bins one bin at a time, the largest piece first.
    """
    size, fill = lengths.tolist(), np.bincount(solution, weights=lengths).astype(np.int64)
    open_ = np.flatnonzero((fill > 0) & (fill < capacity))
    if len(open_) < 2:
        return solution
    is_open = (fill > 0) & (fill < capacity)
    open_ = open_[np.argsort(fill[open_], kind="stable")].tolist()
    members: dict[int, list[int]] = {b: [] for b in open_}
    for i in np.flatnonzero(is_open[solution]).tolist():
        members[int(solution[i])].append(i)
    displaced: list[int] = []
    emptied: list[int] = []
    while len(emptied) < len(open_) and len(displaced) < 2 * WINDOW:
        emptied.append(open_[len(emptied)])
        displaced += members[emptied[-1]]
    displaced = r.permutation(displaced).tolist()
    for b in reversed(open_[len(emptied):]):
        own, tried, displaced = members[b], displaced[:WINDOW], displaced[WINDOW:]
        both = sorted(own + tried, key=size.__getitem__, reverse=True)
        taken = [both[k] for k in best_set([size[i] for i in both], capacity)]
        if sum([size[i] for i in taken]) > fill[b]:
            solution[taken] = b
            inside = set(taken)
            tried = [i for i in both if i not in inside]
        displaced += tried
    displaced.sort(key=size.__getitem__, reverse=True)
    n = len(fill)
    while displaced:
        if emptied:
            b = emptied.pop()
        else:
            b, n = n, n + 1
        near = displaced[1:1 + 3 * WINDOW]
        inside = {0} | {1 + k for k in best_set([size[i] for i in near], capacity - size[displaced[0]])}
        solution[[displaced[k] for k in inside]] = b
        displaced = [i for k, i in enumerate(displaced) if k not in inside]
    return solution


def crossover(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """One parent with some well-filled bins of the other put in whole."""
    fill = np.bincount(two, weights=lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), np.bool_)
    chosen[r.choice(good, max(1, len(good) // INJECTED), replace=False)] = True
    injected = chosen[two]
    # bins that hold an injected piece go, and so do the worst few: their other pieces are displaced
    gone = np.zeros(one.max() + 1, np.bool_)
    gone[one[injected]] = True
    own = np.bincount(one, weights=lengths)
    gone[np.argsort(own)[:3]] = True
    displaced = np.flatnonzero(gone[one] & ~injected)
    child = one.astype(np.int32)
    n = len(own)
    child[injected] = n + two[injected]
    left = np.flatnonzero(~gone)
    free = (capacity - own[left]).astype(np.int64)
    bins = _Bins(capacity, n + len(fill), free[free > 0].tolist(), left[free > 0].tolist())
    size = lengths[displaced] * (1 + 0.02 * r.random(len(displaced)))
    for i in displaced[np.argsort(-size, kind="stable")].tolist():
        child[i] = bins.put(int(lengths[i]))
    return _renumbered(refit(child, lengths, capacity, r))


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: list[int]) -> list[np.ndarray]:
    """POPULATION solutions, best first, after GENERATIONS or once no better one exists.

    What is missing in the given population is made anew: best fit in falling order, and in orders near it.
    """
    r = np.random.default_rng(seed)
    population = population[:POPULATION]
    while len(population) < POPULATION:
        size = lengths * (1 + (0.05 * r.random(len(lengths)) if population else 0.0))
        population.append(best_fit(lengths, np.argsort(-size, kind="stable"), capacity))
    rank = lambda p: sorted(p, key=lambda s: fitness(s, lengths, capacity), reverse=True)
    population = rank(population)
    for _ in range(GENERATIONS):
        if len(lengths) < 2 or settled(population[0], lengths, capacity):
            break
        pairs = [r.choice(len(population), 2, replace=False) for _ in range(CHILDREN)]
        population = rank(population + [crossover(population[a], population[b], lengths, capacity, r) for a, b in pairs])[:POPULATION]
    return population


_STATE = "block long, island int, population array<array<int>>"


def _evolution(capacity: int, epoch: int, seed: int):
    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lengths = np.array(row["lengths"], np.int64)
                given = [_renumbered(np.array(p, np.int32)) for p in row["population"] or []]
                out = evolve(lengths, given, capacity, [seed, epoch, row["island"], row["block"] & 0x7FFFFFFF])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([[p.tolist() for p in out]], pa.list_(pa.list_(pa.int32())))], ["block", "island", "population"])

    return run


def _placed(capacity: int):
    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lengths = np.array(row["lengths"], np.int64)
                best = max((np.array(p, np.int32) for p in row["solutions"]), key=lambda s: fitness(s, lengths, capacity))
                fill = np.bincount(best, weights=lengths)
                order = np.argsort(best, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], np.diff(best[order]) > 0])
                offset = np.empty(len(best), np.int64)
                offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(best))))
                items = pa.array([row["block"]] * len(best), pa.int64())
                yield pa.RecordBatch.from_arrays([items, pa.array(np.arange(len(best)), pa.int32()), pa.array(best), pa.array(offset), pa.array((fill < capacity)[best])], ["block", "nth", "bin", "offset", "open"])

    return run


def _pack_blocks(items: DataFrame, capacity: int, seed: int) -> tuple[DataFrame, str]:
    """items: PIECES and block, and optionally a bin each that begins as a solution. Adds bin, offset and open."""
    spark = items.sparkSession
    own = F.struct((-F.col("length")).alias("neg"), "doc_id", "piece", "start", "ids_crc32", "salt", "bin")
    blocks, blocks_path = materialize(items.groupBy("block").agg(F.array_sort(F.collect_list(own)).alias("items")), "blocks")
    lengths = blocks.select("block", F.transform("items", lambda x: -x["neg"]).alias("lengths"), F.transform("items", lambda x: x["bin"]).alias("given"))
    state, state_path = None, None
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be merged into few tasks
    for epoch in range(EPOCHS):
        if state is None:
            started = F.when(F.exists("given", lambda b: b.isNull()), F.lit(None)).otherwise(F.array("given"))
            at = lengths.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), started.alias("population"))
        else:
            went = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, MIGRANTS).alias("came"))
            met = state.join(went, ["block", "island"]).select("block", "island", F.concat("came", "population").alias("population"))
            at = met.join(lengths.select("block", "lengths"), "block")
        at = at.select("block", "island", "lengths", "population").repartition(spread, "block", "island")
        before = state_path
        state, state_path = materialize(at.mapInArrow(_evolution(capacity, epoch, seed), _STATE), "islands")
        if before:
            discard(spark, before)
    best = state.groupBy("block").agg(F.collect_list(F.col("population")[0]).alias("solutions"))
    placed = best.join(lengths, "block").select("block", "lengths", "solutions").repartition(spread, "block").mapInArrow(_placed(capacity), "block long, nth int, bin int, offset long, open boolean")
    rows = blocks.select("block", F.posexplode("items").alias("nth", "item"))
    packed = rows.join(placed, ["block", "nth"]).select(
        "item.doc_id", "item.piece", "item.start", (-F.col("item.neg")).alias("length"), "item.ids_crc32", "item.salt", "block", placed["bin"], "offset", "open")
    packed, path = materialize(packed, "packed")
    discard(spark, blocks_path)
    discard(spark, state_path)
    return packed, path


@owner
def pack(items: DataFrame, capacity: int = 4096, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """PIECES with sequence_id and offset: gapless places in sequences of at most `capacity` ids.

    Pieces of full length are sequences of their own. The rest are dealt by a hash of id, piece and salt, so neither
    copies nor repeated rows make a block large, and no block depends on the input's size.
    An empty table gives no rows. The written tables make a lost executor cost its own blocks only.
    """
    items, _ = materialize(items, "pieces")
    part = items.where(F.col("length") < capacity)
    n = part.count()
    blocks = max(1, round(n / block))
    dealt = part.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "salt"), F.lit(blocks))).withColumn("bin", F.lit(None).cast("int"))
    first, _ = _pack_blocks(dealt, capacity, seed)
    left = first.where("open")
    # whole blocks' leftovers meet, and begin as they are: the second round cannot do worse
    pools = max(1, round(left.count() / block))
    again = left.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", F.pmod("block", F.lit(pools)).alias("block"), (F.floor(F.col("block") / pools) * 65536 + F.col("bin")).cast("int").alias("bin"))
    second, _ = _pack_blocks(again, capacity, seed + 1)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = items.where(F.col("length") >= capacity).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return (
        first.where(~F.col("open")).select(*own, (F.col("block") * 65536 + F.col("bin")).alias("sequence_id"), "offset")
        .union(second.select(*own, (F.lit(1 << 50) + F.col("block") * 65536 + F.col("bin")).alias("sequence_id"), "offset"))
        .union(full)
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: all pieces of documents, packed."""
    return pack(pieces(docs))

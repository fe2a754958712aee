"""Sharding, mixing and packing: laws that the whole table keeps, and the pipeline."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import mixing, packing, queries, sharding

from .helpers import SCHEMA, corpus

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_shards_hold_each_row_once_and_evenly(spark, docs):
    rows = corpus()
    for bucket in (3000, None):
        out = sharding.shard(docs, 7, bucket_bytes=bucket)
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
        sizes = Counter(r.shard for r in got)
        assert set(sizes) <= set(range(7)) and max(sizes.values()) - min(sizes[s] for s in range(7)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        assert "bucket" in out.columns and out.columns.count("shard") == 1
        assert [(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, 7, bucket_bytes=bucket).collect()] == [(r.doc_id, r.shard, r.slot) for r in got]
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order, key=lambda x: (x is None, x))


def test_equal_rows_spread_over_buckets(spark, tmp_path):
    """Rows equal in all columns, from a scan of files and from another frame, and columns of any name."""
    df = spark.createDataFrame([(1, "the same text", "x", 3)], "doc_id long, text string, row string, bucket int").crossJoin(spark.range(20_000).select()).repartition(4)
    df.write.parquet(str(tmp_path / "rows.parquet"))
    for rows in (spark.read.parquet(str(tmp_path / "rows.parquet")), df):
        sizes = sorted(r["n"] for r in sharding.scatter(rows, 23, 5).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())
        assert len(sizes) == 23 and sizes[0] > 700 and sizes[-1] < 1100
        out = sharding.shard(rows, 16, bucket_bytes=80_000)
        assert out.columns == [*rows.columns, "shard", "slot"]
        shards = Counter(r.shard for r in out.select("shard").collect())
        assert shards == {s: 1250 for s in range(16)}


def test_offsets_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 3)
    counts = spark.createDataFrame([(b, 10 + b) for b in (0, 1, 2, 4, 7, 8, 9, 30)], "bucket int, n long")
    for most in (1_000_000, 0):
        monkeypatch.setattr(sharding, "MAX_BROADCAST_BUCKETS", most)
        assert {r.bucket: r.first for r in sharding._starts(counts, 31).collect()} == {0: 0, 1: 10, 2: 21, 4: 33, 7: 47, 8: 64, 9: 82, 30: 101}


def test_shard_digest_and_few_rows(spark, docs):
    for r in sharding.digest(docs).collect():
        text = {x[0]: x[1] for x in corpus()}[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            raw = (text or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sharding.digest(docs.limit(0)).count() == 0
    assert sorted(r.shard for r in sharding.shard(docs.limit(3), 16).collect()) == [0, 5, 10]


def test_mix_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = Counter(con.sql(f"select doc_id, domain, lang, source, n_tokens, epochs from ({mixing.ORACLE})").fetchall())
    got = Counter(tuple(r) for r in mixing.digest(df).select("doc_id", "domain", "lang", "source", "n_tokens", "epochs").collect())
    assert got == want


def fill(nodes, budget):
    """Water-filling by rounds: {name: (weight, capacity)}."""
    given, open_ = {}, dict(nodes)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c <= w * budget / total}
        if not full:
            return given | {k: w * budget / total for k, (w, _) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[1]
            budget -= given[k]
    return given


def test_shortages_go_to_siblings_first(spark):
    w = mixing.Weights({"a": 3, "b": 1}, {"x": 2}, {})
    leaves = [("a", "x", "s", 10, 1), ("a", "y", "s", 1000, 1), ("b", "x", "s", 500, 1), ("b", "x", "t", 20, 1), ("c", "z", "s", 0, 1)]
    df = spark.createDataFrame(leaves, "mix_domain string, mix_lang string, mix_source string, supply long, rows long")
    got = {(r.mix_domain, r.mix_lang, r.mix_source): r.given for r in mixing.budgets(df, w, F.lit(800), 1).collect()}
    top = fill({"a": (3, 1010), "b": (1, 520)}, 800)
    a, b = fill({"x": (2, 10), "y": (1, 1000)}, top["a"]), fill({"s": (1, 500), "t": (1, 20)}, top["b"])
    want = {("a", "x", "s"): a["x"], ("a", "y", "s"): a["y"], ("b", "x", "s"): b["s"], ("b", "x", "t"): b["t"]}
    assert {k: int(v) for k, v in want.items()} == got
    assert a["x"] == 10 and a["y"] == 590  # the sibling takes it, not b


def test_mix_prefixes_epochs_and_limits(spark, monkeypatch, docs):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 5)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_LEAVES", 0)
    got = mixing.mix(docs, percent=300, max_epochs=2).collect()
    assert {r.epochs for r in got} == {2}  # more is asked than there is
    half = mixing.mix(docs, mixing.Weights(), percent=50, max_epochs=1)
    rows = half.collect()
    taken, supply = sum(r.n_tokens * r.epochs for r in rows), sum(len((r[1] or "").split()) for r in corpus())
    assert 0.3 * supply <= taken <= 0.5 * supply and {r.epochs for r in rows} == {1}
    assert half.columns == [*docs.columns, "domain", "n_tokens", "epochs"]
    assert mixing.mix(docs, percent=0).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_hot_ids_and_clashing_names(spark, monkeypatch):
    """A third of the rows without id, and columns named like those inside: prefixes are as by plain loops up to ties."""
    import hashlib

    monkeypatch.setattr(mixing, "SLICE_ROWS", 4)
    names = ["_full", "_rest", "_slices", "_left", "_cut", "_order", "row", "n", "id", "nth", "whole", "left", "k1", "order", "e1", "e4", "edge", "mix_domain", "supply"]
    r = np.random.default_rng(4)
    rows = [(None if k % 3 == 0 else int(r.integers(0, 60)), " ".join(["w"] * int(r.integers(1, 9))), "en", f"src{k % 2}", *[k] * len(names)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names)).repartition(3)
    for crossing in (False, True):
        out = mixing.mix(df, mixing.Weights(), percent=37, max_epochs=1, crossing=crossing)
        assert out.columns == [*df.columns, "domain", "n_tokens", "epochs"]
        got = out.collect()
        assert len({(x.doc_id, x.e1) for x in got}) == len(got)
        supply = {s: sum(len(x[1].split()) for x in rows if x[3] == s) for s in ("src0", "src1")}
        budget = fill({"web": (1, supply["src0"]), "books": (1, supply["src1"])}, sum(supply.values()) * 37 // 100)
        for s, d in (("src0", "web"), ("src1", "books")):
            key = lambda i: hashlib.md5(f"23:0:{'' if i is None else i}".encode()).hexdigest()
            mine = [x for x in got if x.source == s]
            taken, most = sum(x.n_tokens for x in mine), max(key(x.doc_id) for x in mine)
            assert (0 <= taken - int(budget[d]) < 8) if crossing else (0 <= int(budget[d]) - taken < 8)
            # all rows before the last id in the order are taken, none after it
            assert sum(len(x[1].split()) for x in rows if x[3] == s and key(x[0]) < most) == sum(x.n_tokens for x in mine if key(x.doc_id) < most)


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check_packing(rows, got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for (i, *_), ids in zip(rows, reference_ids([r[1] for r in rows])):
        for p, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], "<u4")
            want[i, p, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    return len(by), -(-total // capacity)


def test_packing_keeps_every_token_and_packs_well(spark, docs):
    rows = corpus()
    bins, least = check_packing(rows, packing.pack(packing.pieces(docs, 512), 512, block=40).collect(), 512)
    assert bins <= least + 2
    assert packing.digest(docs.limit(0)).count() == 0
    bins, least = check_packing(rows, packing.digest(docs).collect(), 4096)
    assert bins <= least + 1


def test_crossover_keeps_groupings_sound():
    r = np.random.default_rng(0)
    lengths = np.sort(r.integers(1, 60, 300))[::-1].copy()
    population = packing.evolve(lengths, [], 100, [1])
    for s in population + [packing.crossover(population[0], population[-1], lengths, 100, r)]:
        assert len(s) == 300 and np.bincount(s, weights=lengths).max() <= 100 and (np.bincount(s) > 0).all()
    first = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 100)
    assert packing.fitness(population[0], lengths, 100) >= packing.fitness(first, lengths, 100)


def missed_blocks(n):
    """Blocks of lengths like the documents', with sums just below a multiple of the capacity: best fit in falling order misses the bound."""
    r, out = np.random.default_rng(11), []
    while len(out) < n:
        lengths = np.sort(np.minimum(r.lognormal(6.4, 1.0, 2500).astype(int) + 8, 4095))[::-1].astype(np.int64)
        short = -int(lengths.sum()) % 4096
        lengths[:short // 8 + 1] = np.minimum(lengths[:short // 8 + 1] + 8, 4095)
        lengths = np.sort(lengths)[::-1].copy()
        first = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 4096)
        if first.max() + 1 > -(-int(lengths.sum()) // 4096):
            out.append((lengths, first))
    return out


def test_crossover_closes_the_gaps_that_best_fit_leaves(monkeypatch):
    ran, own, won = [], packing.crossover, 0
    monkeypatch.setattr(packing, "crossover", lambda *a: (ran.append(1), own(*a))[1])
    blocks = missed_blocks(8)
    for k, (lengths, first) in enumerate(blocks):
        before = len(ran)
        population = packing.evolve(lengths, [], 4096, [k])
        for epoch in range(1, 3):
            population = packing.evolve(lengths, population, 4096, [k, epoch])
        fill = np.bincount(population[0], weights=lengths)
        assert len(ran) > before and fill.max() <= 4096 and len(fill) <= first.max() + 1
        won += len(fill) == -(-int(lengths.sum()) // 4096) < first.max() + 1
    assert won > len(blocks) // 2


def test_best_set_against_all_sets():
    import itertools

    r = np.random.default_rng(3)
    for _ in range(60):
        sizes = sorted(r.integers(1, 50, int(r.integers(0, 9))).tolist(), reverse=True)
        room = int(r.integers(0, 120))
        got = packing.best_set(sizes, room)
        sums = [sum(s) for k in range(len(sizes) + 1) for s in itertools.combinations(sizes, k)]
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == max(x for x in sums if x <= room)


def test_words_that_hold_special_tokens(spark):
    from pairwright.llm.tokens import WordTokenizer
    import pyarrow as pa

    texts = ["a<|startoftext|>b <|startoftext|> x", "<|endoftext|>y", "plain 'tis it's 3rd\u0301 Ünï", "<<|startoftext", "", "<|startoftext|>"]
    ids, offsets = WordTokenizer(packing.default_tokenizer()).encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == reference_ids(texts)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_the_small_tables(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0

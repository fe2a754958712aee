"""Near duplicates of texts and of vectors against all pairs."""

import itertools
import re

import numpy as np
import pytest

from pairwright.llm import minhash, vectors

from .helpers import SCHEMA, corpus

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, linked):
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return least


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    linked = []
    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            linked.append((a, b))
    return components(list(sets), linked)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(spark, percent):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), percent).collect()
    assert len(got) == len(rows)
    want = brute([r[:2] for r in rows if r[0] is not None], percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {(r.doc_id, r.n_shingles) for r in got}
    assert sizes == {(r[0], len(shingles(r[1]))) for r in rows}


def test_large_groups_in_small_chunks(spark, monkeypatch):
    """Overlapping families whose links the centres alone do not find."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 4)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", 300)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_ROWS", 0)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 90])) for i in range(60)] + [(100 + i, " ".join(words[7 * i:7 * i + 80])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 85)


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = minhash.deduplicate(df, 85)
    assert kept.columns == df.columns
    want = brute([r[:2] for r in rows if r[0] is not None], 85)
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(k for k, v in want.items() if k == v)
    assert kept.where("doc_id is null").count() == 2


def test_no_rows_and_low_similarity(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame([], SCHEMA), 70)


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 6)
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 16))
    rows = []
    for i in range(150):
        noise = r.choice([0.0, 0.02, 0.05, 0.09])
        rows.append((i, [float(np.float32(x)) for x in base[i % 12] + noise * r.normal(size=16)], i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(210, [2 * x for x in rows[0][1]], 0)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, rows[0][1], None), (305, [float("inf")] * 16, 1), (306, [], 0), (307, [1.0, 2.0], 0), (308, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows + odd], "vec_id long, embedding array<float>, label int, id int, code string")
    got = {x.vec_id: x for x in vectors.near_duplicates(df).collect()}
    sound = rows + [x for x in odd if x[0] in (307, 308)]
    linked = []
    for (a, x, p), (b, y, q) in itertools.combinations(sound, 2):
        if p == q and len(x) == len(y):
            x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                linked.append((a, b))
    want = components([x[0] for x in sound], linked)
    for i, _, _ in sound:
        n = sum(i in pair for pair in linked)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, want[i], want[i] == i), i
    for i, _, _ in odd:
        if i not in (307, 308):
            assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_deduplicate_goes_by_row(spark):
    words = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcd"]
    rows = [(1, words[0], "x"), (5, words[0], "y"), (5, words[1], "z"), (9, words[2], "s"), (9, words[2], "t"), (None, words[3], "u"), (None, words[3], "v"), (7, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    got = minhash.deduplicate(df, percent=80)
    assert got.columns == df.columns
    kept = [tuple(r)[:2] for r in got.collect()]
    groups = [[(1, words[0]), (5, words[0])], [(5, words[1])], [(9, words[2])], [(7, None)]]
    assert all(sum(kept.count(x) for x in group) == 1 for group in groups) and kept.count((None, words[3])) == 2 and len(kept) == 6


def test_repeated_vector_ids_are_vectors_of_their_own(spark):
    near = [[1.0, 0.01 * k, 0.0, 0.0] for k in range(3)]
    rows = [(1, near[0], 0), (1, near[1], 0), (2, near[2], 0), (1, [0.0, 0.0, 1.0, 0.0], 1), (5, [0.0, 0.0, 1.0, 0.0], 2), (5, [0.0, 0.0, 2.0, 0.0], 2), (4, [0.0, 1.0, 1.0, 0.0], 0), (1, [0.0, 1.0, 1.01, 0.0], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 1, 1, False), (5, 1, 5, True), (5, 1, 5, True)]


@pytest.mark.parametrize("vertices", sorted(vectors.TABLES))
def test_recall_of_pairs_at_the_threshold(vertices):
    r = np.random.default_rng(vertices)
    x = r.normal(size=(3000, 64))
    y = r.normal(size=x.shape)
    x, y = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y - (x * y).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x))
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    a, b = vectors.bucket_keys(x, vertices), vectors.bucket_keys(near, vertices)
    met = np.array([(a[:, t][:, :, None] == b[:, t][:, None, :]).any(axis=(1, 2)) for t in range(vectors.TABLES[vertices])])
    assert met.any(axis=0).mean() >= 0.9999 and met.mean() < 1


def test_layout_follows_the_largest_label():
    assert [vectors.layout(n, 64) for n in (0, 1000, 2000, 140_000, 200_000, 18_000_000, 10**9, 10**12)] == [2, 2, 3, 3, 4, 4, 5, 5]


def test_operators_leave_only_what_their_results_read(spark):
    from pairwright.llm import storage

    storage.release(spark)
    rows = corpus(40)
    result = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert len(storage.held_tables()) == 1 and result.count() == len(rows)
    storage.release(spark)
    assert storage.held_tables() == []

"""Each stage of the pipeline against plain loops on its own input."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import langid, quality_rules, storage

from .helpers import SCHEMA, corpus
from .test_dedup import WORD, brute, shingles
from .test_tables import check_packing, fill
from .test_texts import phrases_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [x for x in corpus(60) if x[0] is not None]
    return spark.createDataFrame(rows, SCHEMA).dropDuplicates(["doc_id"]).select(*COLUMNS[:4], F.length("text").cast("long").alias("n_chars")).repartition(3).cache()


def kept(stage, spark, docs):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_language_stage(spark, docs, monkeypatch):
    learned = {}
    own = langid.Model.__init__
    monkeypatch.setattr(langid.Model, "__init__", lambda self, samples: (learned.update(samples), own(self, samples))[1])
    got = kept("language", spark, docs)

    def plain(raw):
        return bytes(langid.plain(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])

    want = []
    for r in docs.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            continue
        cost = {}
        for lang, sample in sorted(learned.items()):
            s = plain(sample)
            data, offsets = langid.plain(*langid.B.buffer_of(pa.array([text])))
            cost[lang] = phrases_by_hand(s, bytes(data)) * math.log2(len(s))
        best = min(cost, key=lambda k: (cost[k], k))
        second = sorted(cost.values())[1]
        if not (r.lang and best != r.lang and second / (cost[best] + second) >= 0.6 and len(text) >= 200):
            want.append(r.doc_id)
    assert got == sorted(want) and 0 < len(got) < docs.count()


def js(p, q):
    d = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        d += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(d, 0.0))


def char_class(c):
    if ord(c) >= 0x80:
        return "wide"
    for name, held in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\x0b\x0c\r"), ("symbol", "#*$%&|<>"), ("mark", ".,;:!?'\"()-")):
        if c in held:
            return name
    return "other"


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


UPPER = {v: k for k, v in LOWER.items()}


def share(counter):
    total = sum(counter.values())
    return {k: v / total for k, v in counter.items()} if total else {}


def verdicts(rows):
    """doc_id: kept, by plain loops: base rule and distances from references made of all rows."""
    refs = {}
    for lang in {r.lang for r in rows if r.lang is not None and r.text is not None}:
        texts = [r.text for r in rows if r.lang == lang and r.text is not None]
        words = Counter(w for t in texts for w in WORD.findall(t.translate(LOWER)))
        n = sum(words.values())
        if n:
            common = {w: c / n for w, c in words.items() if c >= 0.004 * n}
            refs[lang] = share(Counter(char_class(c) for t in texts for c in t)), common, 1 - sum(common.values())
    out = {}
    for r in rows:
        text = r.text or ""
        w = WORD.findall(text)
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        often, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if often[x] > 1:
                covered.update(range(k, k + 8))
        ok = not (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        if ok and len(text) >= 200 and len(w) >= 40 and refs:
            classes, low = share(Counter(map(char_class, text))), Counter(WORD.findall(text.translate(LOWER)))
            found = []
            for lang, (ref_class, common, other) in refs.items():
                own = {k: low[k] / len(w) for k in common}
                found.append((js({**own, None: 1 - sum(own.values())}, {**common, None: other}), js(classes, ref_class)))
            word, cls = min(found, key=sum)
            ok = word <= 0.42 and cls <= 0.28
        out[r.doc_id] = ok
    return out


def test_quality_stage(spark, docs):
    want = verdicts(docs.collect())
    assert kept("quality", spark, docs) == sorted(i for i, ok in want.items() if ok) and 0 < sum(want.values()) < len(want)


def test_long_words_and_many_languages_count(spark):
    """Common words of any length and more languages than fit in a byte, against plain loops."""
    r = np.random.default_rng(5)
    rows = []
    for lang in range(270):
        words = ["".join(r.choice(list("abcdefghijklmnop\u0436\u8a9e"), 12)) for _ in range(12)]
        for k in range(2):
            text = " ".join(r.choice(words, 50))
            rows.append((lang * 10 + k, text if k else text.translate(UPPER), f"l{lang}"))
    df = spark.createDataFrame([*rows, (9999, " ".join(f"unheard{k}" for k in range(70)), None)], "doc_id long, text string, lang string")
    refs = quality_rules.references(df)
    assert len(refs) == 270 and all(len(keys) == 12 for _, keys, _ in refs.values())
    got = {x.doc_id: x.kept for x in quality_rules.assess(df, refs).collect()}
    want = verdicts(df.collect())
    assert {i: got[i] for i in want} == want and not got[9999]


def test_near_duplicates_stage(spark, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert kept("near_duplicates", spark, docs) == sorted(k for k, v in want.items() if k == v)


def test_mixing_stage(spark, docs):
    docs = docs.where("n_chars is null or n_chars < 20000")  # a document longer than the rest of its leaf would be crossed
    rows = [(r.doc_id, len(WORD.findall(r.text or "")), r.lang or "", r.source or "") for r in docs.collect()]
    rows = [r for r in rows if r[1]]
    domain = lambda s: ("web", "books", "code")[int(s[3:]) % 3] if s.startswith("src") else "" if s == "" else "other"
    weights = ({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"src0": 3})
    leaf = Counter()
    for _, n, lang, source in rows:
        leaf[domain(source), lang, source] += n

    def down(budget, prefix):
        level = len(prefix)
        if level == 3:
            return {prefix: int(budget)}
        names = sorted({k[level] for k in leaf if k[:level] == prefix})
        nodes = {x: (weights[level].get(x, 1), sum(v for k, v in leaf.items() if k[:level + 1] == (*prefix, x))) for x in names}
        out = {}
        for x, given in fill(nodes, budget).items():
            out |= down(math.floor(given + 1e-9), (*prefix, x))
        return out

    budgets, want = down(sum(leaf.values()) * 90 // 100, ()), []
    for key, budget in budgets.items():
        whole, left = divmod(budget, leaf[key])
        own = [r for r in rows if (domain(r[3]), r[2], r[3]) == key]
        own.sort(key=lambda r: hashlib.md5(f"23:{whole}:{r[0]}".encode()).hexdigest())
        for r in own:
            if whole or left > 0:
                want.append(r[0])
            left -= r[1]
    assert kept("mixing", spark, docs) == sorted(want) and 0 < len(want) < len(rows)


def test_packing_stage_and_the_whole(spark, docs, tmp_path):
    rows = [tuple(r) for r in docs.collect()]
    bins, least = check_packing(rows, corpus_pipeline.packed(spark, docs, "").collect(), 4096)
    assert bins == least
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    storage.release(spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), docs.schema)
    assert {r.doc_id for r in got} == {r.doc_id for r in at.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    storage.release(spark)
    result = corpus_pipeline.run(spark, str(tmp_path))
    # what is left on disk is the last stage's input and what the result reads
    assert len(storage.held_tables()) <= 4 and result.count() == len(got)


def test_stages_without_rows(spark, docs):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_shingles_by_hand():
    assert len(shingles("a b c d e f a b c d e")) == 6 and list(itertools.islice(shingles("A b"), 1)) == [("a", "b")]

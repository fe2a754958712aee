"""Operators that look at one text at a time, against plain loops."""

import re
import re._parser
import zlib
from collections import Counter
from itertools import product

import pyarrow as pa
import pytest

from pairwright.llm import langid, licenses, quality_model, quality_rules

from .helpers import SCHEMA, corpus, sentence

WORD = re.compile("[^\x20\x09-\x0D]+")


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality_rules.digest(docs).collect() if r.doc_id is not None}
    for i, text, *_ in corpus():
        if i is None:
            continue
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        often, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if often[x] > 1:
                covered.update(range(k, k + 8))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>")), i
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_divergence_spots_junk_and_keeps_prose(spark):
    import random

    r = random.Random(3)
    prose = [(i, sentence(r, "en", 150), "en") for i in range(40)]
    junk = [(100, " ".join(x + "***" for x in sentence(r, "en", 150).split()), "en"), (101, "1 2 3 4 5 6 7 8 9 10 " * 3 + " ".join(str(i) for i in range(100, 200)), "en")]
    df = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in quality_rules.digest(df).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101]


def test_quality_without_references_and_rows(spark, docs):
    assert quality_rules.digest(docs.limit(0)).count() == 0
    alone = docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 5")
    assert quality_rules.references(docs.where("text is null")) == {}
    assert alone.count() == 5 and set(quality_rules.digest(alone).columns) == set(quality_rules.digest(docs).columns)
    full = quality_rules.assess(docs, {})
    assert full.columns[:8] == docs.columns and full.count() == docs.count()


def test_js_distance():
    import numpy as np

    assert quality_rules.js_distance(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.0, 1.0])).round(6).tolist() == [1.0, round(float(np.sqrt(0.311278)), 6)]


def phrases_by_hand(sample: bytes, text: bytes) -> int:
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at += max(size, 1)
        n += 1
    return n


def test_cross_parsing_against_longest_matches():
    import random

    r = random.Random(5)
    samples = {k: sentence(r, k, 120).encode() for k in ("en", "de")}
    model = langid.Model(samples)
    texts = [sentence(r, "de", 20), "x", "äöü", "", "Zz qq 77 !!"] + [sentence(r, "en", 3)]
    data, offsets = langid.plain(*langid.B.buffer_of(pa.array(texts)))
    got = model.phrases(data, offsets)
    for k, name in enumerate(model.languages):
        import numpy as np

        sample = bytes(langid.plain(np.frombuffer(samples[name], np.uint8), np.array([0, len(samples[name])]))[0])
        for i in range(len(texts)):
            assert got[i, k] == phrases_by_hand(sample, bytes(data[offsets[i]:offsets[i + 1]])), (name, texts[i])


def test_phrases_go_over_segments():
    """Texts of many segments: one substring of the sample, prose, and strings on which parses never meet."""
    import random

    r = random.Random(12)
    samples = {k: sentence(r, k, 700).encode() for k in ("en", "de")} | {"aa": b"a" * 3000 + b"b" * 40}
    model = langid.Model(samples)
    one = samples["en"][100:2740].decode()
    texts = [one, one * 2, sentence(r, "de", 900), "a" * 5000, "ab" * 2100, "a" * 1500 + "b" + "a" * 2600, sentence(r, "fr", 400) + one[:1200], "x" * 2049, one[:1024], one[:1025]]
    data, offsets = langid.plain(*langid.B.buffer_of(pa.array(texts)))
    got = model.phrases(data, offsets)
    for k, name in enumerate(model.languages):
        sample = bytes(langid.plain(langid.np.frombuffer(samples[name], langid.np.uint8), langid.np.array([0, len(samples[name])]))[0])
        for i in range(len(texts)):
            assert got[i, k] == phrases_by_hand(sample, bytes(data[offsets[i]:offsets[i + 1]])), (name, i)
    assert got[0, model.languages.index("en")] == 1


def test_rows_are_learned_whole_within_bounds(spark):
    rows = [(k, f"text {k} " * (1 + k % 7), "a" if k % 3 else "b") for k in range(300)] + [(1000, "long " * 400, "c"), (1001, "longer " * 400, "c"), (None, "x", None), (2, None, "a")] + [(5, "same", "d")] * 500
    df = spark.createDataFrame(rows, "id long, text string, group string").repartition(5)
    got = langid.sample_rows(df, 6, 120)
    texts = {(g, t) for _, t, g in rows}
    assert set(got) <= texts and got == langid.sample_rows(df.repartition(2), 6, 120)
    by = {g: [t for h, t in got if h == g] for g in "abcd"}
    assert all(0 < len(by[g]) <= 6 for g in "abcd") and all(sum(map(len, by[g])) <= 120 for g in "abd") and by["c"] == ["long " * 400] and by["d"] == ["same"]


def test_languages_held_out(spark, docs):
    got = langid.digest(docs).collect()
    truth = {r[0]: (r[1], r[2]) for r in corpus()}
    assert len(got) == len(corpus())
    right = [r.lang_pred == truth[r.doc_id][1] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= 0.95 * len(right) > 0
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        text = truth[r.doc_id][0]
        if r.doc_id is not None and not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}


def test_more_languages_than_one_pass_and_one_block_take(spark):
    import random

    r = random.Random(8)
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(k * 100 + i, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for k, lang in enumerate(words) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(df).languages == sorted(words)
    truth = {i: lang for i, _, lang in rows}
    got = langid.digest(df).collect()
    assert len(got) == len(rows) and all(x.lang_pred == truth[x.doc_id] for x in got)
    samples = {k: " ".join(w).encode() for k, w in words.items()}
    data, offsets = langid.plain(*langid.B.buffer_of(pa.array([x[1] for x in rows[:20]])))
    one, many = langid.Model(samples), langid.Model(samples, table_bytes=50_000)
    assert len(one.blocks) == 1 < len(many.blocks) and (one.phrases(data, offsets) == many.phrases(data, offsets)).all()


def test_language_without_labels_and_rows(spark, docs):
    nothing = docs.where("text is null")
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}
    assert langid.digest(docs.limit(0)).count() == 0
    assert langid.identify(docs, langid.Model({"en": b"the"}), returned=["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score", "bits_per_byte"]


def test_classifier_learns_and_scores_every_text(spark):
    import random

    r = random.Random(6)
    rows = [(i, sentence(r, "en", 80) if i % 3 else " ".join(x + "#$%" for x in sentence(r, "en", 80).split())) for i in range(240)] + [(900, None), (901, ""), (902, sentence(r, "en", 20000)), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_model.digest(df, labels).collect()}
    assert len(got) == len(rows)
    test = [i for i in range(240) if held(i)]
    assert sum(got[i].predicted == int(i % 3 > 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and x.held_out == held(x.doc_id) for x in got.values())
    assert got[900].score == got[901].score and got[902].predicted == 1


def score_by_hand(net, text):
    """The network by plain loops over one text's bytes."""
    import math

    q = quality_model
    raw = text.encode()
    unit = q.BLOCK * q.STRIDE
    blocks = (len(raw) + q.STRIDE + unit - 1) // unit
    padded = [0] * q.STRIDE + list(raw) + [0] * (blocks * unit - len(raw))
    tops = []
    for b in range(blocks):
        best = [-math.inf] * q.FILTERS
        for p in range(b * q.BLOCK, (b + 1) * q.BLOCK):
            seen = padded[p * q.STRIDE:(p + 2) * q.STRIDE]
            for f in range(q.FILTERS):
                total = 0.0
                for k, byte in enumerate(seen):
                    weights = net.left if k < q.STRIDE else net.right
                    for e in range(q.EMBED):
                        total += float(net.embed[byte, e]) * float(weights[k % q.STRIDE * q.EMBED + e, f])
                best[f] = max(best[f], total)
        tops.append(best)
    chunks = []
    for n in range(max(1, -(-(blocks - q.CHUNK) // q.STEP) + 1)):
        part = [tops[min(n * q.STEP + k, blocks - 1)] for k in range(q.CHUNK)]
        chunks.append([max(max(t[f] for t in part) + float(net.bias[f]), 0.0) for f in range(q.FILTERS)])
    features = [max(c[f] for c in chunks) for f in range(q.FILTERS)] + [sum(c[f] for c in chunks) / len(chunks) for f in range(q.FILTERS)]
    return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(features, net.out)) - float(net.shift[0])))


def test_scores_against_plain_loops():
    import random

    r, net = random.Random(2), quality_model._fresh(5)
    texts = ["", "x", "Ünï", "a" * 124, "a" * 125, sentence(r, "en", 60), sentence(r, "de", 300)]
    for at in (texts, texts[::-1]):
        got = quality_model.probabilities(net, pa.array(at))
        assert all(abs(p - score_by_hand(net, t)) < 1e-5 for p, t in zip(got, at))


def test_training_takes_whole_texts_in_bounded_batches():
    import numpy as np

    size = np.array([10] * 40 + [300_000] + [90_000] * 3)
    got = list(quality_model._batches(np.arange(len(size)), size))
    assert sorted(np.concatenate(got)) == list(range(len(size))) and all(len(b) <= 32 and (len(b) == 1 or size[b].sum() <= 200_000) for b in got)
    flawed = ["good words here " * 900 + ("### " * 40 if k % 2 else "fine end " * 18) for k in range(40)]
    net = quality_model.train(flawed, [1 - k % 2 for k in range(40)])
    p = quality_model.probabilities(net, pa.array(flawed[:8]))
    assert all((p[k] >= 0.5) == (k % 2 == 0) for k in range(8))


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality_model.digest(df, none).collect()} == {0.5}
    assert quality_model.digest(df.limit(0), none).count() == 0


def test_gradients_by_differences():
    import numpy as np

    net = quality_model._fresh(1)
    data, offsets = quality_model.B.buffer_of(pa.array(["some text that is long enough " * 20, "other ### words", ""]))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = quality_model._forward(net, data, offsets)
        return -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))

    p, kept = quality_model._forward(net, data, offsets)
    grad = quality_model._gradients(net, kept, (p - y).astype(np.float32))
    for name in ("left", "right", "bias", "out", "embed"):
        w, g = getattr(net, name), getattr(grad, name)
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep, step = w[at], 2e-3
        w[at] = keep + step
        up = loss()
        w[at] = keep - step
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * step) - g[at]) <= 0.05 * abs(g[at]) + 2e-2, name


BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]


def test_license_phrases_against_loops(spark):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [
        "GNU General Public License, mit\nlicense MIT-License", "cc-by CC BY cc by-sa 4.0", "émit license mit licenses", "apache license apache license", "", None, "nothing here",
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT license", "K license mit LICENSE", "all rights reserved. " * 3 + "x " * 5000 + "gnu general public license v3 " * 400]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in licenses.digest(df).collect()}
    for i, text in enumerate(texts):
        w = word.findall((text or "").translate(lower))
        hits = [(k, label) for label, p in BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits)), text
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "apache-2.0" in got[7].labels and got[7].score == 1.0
    assert got[6].labels == "" and got[6].score == 0
    assert licenses.digest(df.limit(0)).count() == 0


def test_priority_and_containment(spark):
    rules = [licenses.Rule("long", "b", "a b c", 2, 0.9), licenses.Rule("short", "b", "b", 1, 0.5), licenses.Rule("strong", "c", "c", 3, 1.0), licenses.Rule("out", "d", "c d", 1, 0.4), licenses.Rule("gated", "zz", "a", 3, 1.0)]
    df = spark.createDataFrame([("licence a b c d",), ("licence b zz",)], "text string")
    got = licenses.scan(df, rules).collect()
    # short lies within long; strong outranks long; out reaches past it
    assert got[0].license_labels == ["long", "out", "strong"] and got[0].n_kept == 3 and len(got[0].detections) == 4
    assert got[1].license_labels == ["short"] and got[1].license_score == 0.5


def test_there_are_hundreds_of_signatures():
    rules = licenses.default_rules()
    assert len(rules) > 250 and len({r.label for r in rules}) > 120 and len({r.pattern for r in rules if not r.base}) == len([r for r in rules if not r.base])
    for r in rules:
        re.compile(r.pattern)


def test_every_rule_passes_the_gate(spark):
    """Texts that hold no other word of a license than their rule's own."""
    expected = {
        "Released under GPLv2.": "gpl-2.0", "distributed under the BSD 3-Clause": "bsd-3-clause", "MPL 2.0": "mpl-2.0", "MIT No Attribution": "mit-0",
        "This program is free software; you can redistribute it and/or modify it": "gpl", "This library is free software; you can redistribute it and/or modify it": "lgpl",
        "This software is provided as is, without any express or implied warranty": "zlib", "Permission to use, copy, modify and distribute this software": "isc", "see CC-BY 4.0": "cc-by-4.0"}
    rows = list(expected.items()) + [("success, by and by", ""), ("an omitted line", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(df).collect()}
    for i, (text, label) in enumerate(rows):
        assert label in got[i].labels.split(",") and (got[i].score > 0) == (label != ""), text
    own = [licenses.Rule("odd", "zebra crossing", "zebra crossing", 1, 0.5), licenses.Rule("any", "", "tapir", 1, 0.5)]
    assert [r.license_labels for r in licenses.scan(spark.createDataFrame([("a Zebra, crossing",), ("tapir",), ("none",)], "text string"), own).collect()] == [["odd"], ["any"], []]


def alternatives(tree) -> list[str]:
    """What a parsed pattern matches: each branch, optional parts without and with, of classes and spans one example."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            these = [chr(arg)]
        elif name == "IN":
            these = [chr(x[0] if str(kind) == "RANGE" else x) for kind, x in arg]
        elif name == "ANY":
            these = ["x"]
        elif name == "SUBPATTERN":
            these = alternatives(arg[-1])
        elif name == "BRANCH":
            these = [x for branch in arg[1] for x in alternatives(branch)]
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            these = [x * max(arg[0], 1) for x in alternatives(arg[2])] + ([""] if arg[0] == 0 else [])
        out = [a + b for a, b in product(out, these)]
    return out


def test_every_match_passes_its_prefilter(spark):
    for r in licenses.default_rules():
        matches = alternatives(re._parser.parse(r.pattern))
        for text in {min(matches, key=len), *matches}:
            assert re.fullmatch(r.pattern, text) and any(" " + k in " " + text for k in r.keyword.split("|")), (r.pattern, text)
    expected = {"GNU Library General Public License": "lgpl", "Expat License": "mit", "0BSD": "0bsd", "FreeBSD license": "bsd-2-clause", "zlib/libpng license": "zlib"}
    df = spark.createDataFrame(list(expected.items()), "text string, label string")
    assert all(r.label in r.license_labels for r in licenses.scan(df).collect())


def scan_by_hand(text: str, rules) -> tuple[list[tuple], set[str], float]:
    """All detections, the labels that priority and containment leave, and the score, by plain loops."""
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    plain = " " + " ".join(words)
    starts, at = {}, 1
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    ends = {s + len(words[i]): i for s, i in starts.items()}
    found = []
    for r in rules:
        if any(" " + k in plain for k in r.keyword.split("|")):
            for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= |$)", plain):
                found.append((starts[m.start()], ends[m.end()], r.priority, r.label, r.weight, r.base))
    kept = []
    for k, (first, last, priority, label, weight, base) in enumerate(found):
        over = [f for j, f in enumerate(found) if j != k and f[0] <= first and f[1] >= last and f[2] >= priority and (f[:3] != (first, last, priority) or (f[3], f[4], f[5], j) < (label, weight, base, k))]
        if not over:
            kept.append((label, weight))
    return found, {x[0] for x in kept}, max((x[1] for x in kept), default=0.0)


def test_an_example_of_every_rule_against_plain_loops(spark):
    """Each rule's shortest and longest examples, alone and within prose, found as plain Python finds them."""
    rules = licenses.default_rules()
    texts = []
    for r in rules:
        matches = sorted(set(alternatives(re._parser.parse(r.pattern))), key=lambda t: (len(t), t))
        texts += [matches[0].upper() if matches[0].isascii() else matches[0], "some words, then: " + matches[-1].replace(" ", "-") + ". And more (c) 2020 all rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        found, labels, score = scan_by_hand(text, rules)
        r = got[i]
        assert sorted((d.first, d.last, d.priority, d.label, d.weight, d.base) for d in r.detections) == sorted(found), text
        base = {f[3] for f in found if f[5]}
        assert set(r.license_labels) == labels | base and r.license_score == score, text
        assert rules[i // 2].label in {f[3] for f in found}, (text, rules[i // 2])


def test_scan_of_empty_tables_and_copies(spark):
    df = spark.createDataFrame([(k, "SPDX-License-Identifier: MIT") for k in range(5)] + [(9, None), (10, ""), (11, "word " * 50000 + "see license file")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(df).collect()}
    assert {got[k].labels for k in range(5)} == {"mit"} and got[9].labels == got[10].labels == "" and "license-reference" in got[11].labels
    assert licenses.scan(df.limit(0)).count() == 0

"""Quality rules: counts per text, and divergence of its histograms from its language's.

References are one character-class histogram and one common-word histogram for each
language, counted over every labelled row. A common word is one that makes up at least `share` of its language's words, so
there are at most 1 / share of them; words are lower-cased (A-Z) and known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import bytescan as B
from .storage import discard, materialize, without

#: Keys held in a worker before they are summed, and given out if that leaves half of them (16 MB).
MAX_HELD = 1_000_000
SYMBOLS = b"#*$%&|<>"
#: Character classes, by byte; bytes that go on a code point count nothing.
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "other", "wide"]
_MARKS = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    """256 x classes: 1 where a byte counts for a class."""
    out = np.zeros((256, len(CLASSES)))
    for b in range(256):
        if 0x80 <= b < 0xC0:
            continue
        if b >= 0xC0:
            name = "wide"
        elif 97 <= b <= 122:
            name = "lower"
        elif 65 <= b <= 90:
            name = "upper"
        elif 48 <= b <= 57:
            name = "digit"
        elif b in (32, 9, 10, 11, 12, 13):
            name = "space"
        elif b in SYMBOLS:
            name = "symbol"
        elif b in _MARKS:
            name = "mark"
        else:
            name = "other"
        out[b, CLASSES.index(name)] = 1
    return out


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, 256), np.int64)
    for i in range(len(out)):
        if offsets[i + 1] > offsets[i]:
            out[i] = np.bincount(data[offsets[i]:offsets[i + 1]], minlength=256)
    return out


def _word_keys(words: B.Words) -> np.ndarray:
    """A 64-bit key of each word, without case of A-Z."""
    return B.span_hashes(B.LOWER[words.data], words.starts, words.ends).view(np.int64)


def _count_references(batches):
    """Rows lang, kind, key, n; summed within the partition first, in bounded memory."""
    B.claim("quality_rules")
    table = _class_table()
    held: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed():
        for of, parts in held.items():
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[of] = [(keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]
        return sum(len(parts[0][0]) for parts in held.values())

    def flush():
        summed()
        for (lang, kind), [(keys, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "kind", "key", "n"])
        held.clear()

    for batch in B.slices(batches):
        data, offsets = B.buffer_of(batch.column(1))
        words = B.Words(data, offsets)
        counts = _byte_counts(data, offsets) @ table
        langs, at = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        value, of_word = _word_keys(words), np.repeat(at, words.counts)
        for k, lang in enumerate(langs):
            made = {"class": (np.arange(len(CLASSES)), counts[at == k].sum(axis=0).astype(np.int64)), "words": (np.zeros(1, np.int64), np.array([words.counts[at == k].sum()])), "word": np.unique(value[of_word == k], return_counts=True)}
            for kind, part in made.items():
                held.setdefault((str(lang), kind), []).append(part)
                size += len(part[0])
        if size > MAX_HELD:
            size = summed()
            if size > MAX_HELD // 2:
                yield from flush()
                size = 0
    yield from flush()


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.004) -> dict:
    """{language: (class histogram, common words, their histogram with all others last)}.

    Counted over all rows with text and language, all languages and all words; 1 / share words and a few numbers of each language
    come to the driver. No labelled text: no references, and nothing diverges.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_references, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted, path = materialize(counted, "references")
    totals = counted.where("kind = 'words' and n > 0").select("lang", F.col("n").alias("total"))
    total = {r["lang"]: r["total"] for r in totals.collect()}
    kept = counted.join(totals, "lang").where((F.col("kind") == "class") | ((F.col("kind") == "word") & (F.col("n") >= share * F.col("total"))))
    found: dict[str, dict[str, dict[int, int]]] = {}
    for r in kept.select("lang", "kind", "key", "n").collect():
        found.setdefault(r["lang"], {"class": {}, "word": {}})[r["kind"]][r["key"]] = r["n"]
    discard(df.sparkSession, path)
    out = {}
    for lang, got in sorted(found.items()):
        classes = np.array([got["class"].get(k, 0) for k in range(len(CLASSES))], float)
        keys = np.array(sorted(got["word"]), np.int64)
        n = np.array([got["word"][k] for k in keys], float)
        out[lang] = classes / max(classes.sum(), 1), keys, np.append(n, total[lang] - n.sum()) / total[lang]
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(np.broadcast_to(q, m.shape) / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _repeats(words: B.Words, n: int = 8) -> np.ndarray:
    """Words of each text that stand in an n-word window found twice or more in it."""
    out = np.zeros(len(words.counts), np.int64)
    hashes, offsets = B.windows(words.hashes(), words.first, n)
    for d in np.flatnonzero(np.diff(offsets) > 1):
        own = hashes[offsets[d]:offsets[d + 1]]
        order = np.sort(own)
        same = order[1:] == order[:-1]
        if same.any():
            twice = np.isin(own, order[1:][same])
            cover = np.zeros(len(own) + n, np.int64)
            cover[:len(own)] += twice
            cover[n:] -= twice
            out[d] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def _dup_lines(words: B.Words) -> np.ndarray:
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    # a line ends before its \n; one cut off by the end of its text has none
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[held], ends[held]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    key = B.mix(B.span_hashes(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
          ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("nearest_lang", T.StringType())]


def measure(texts: pa.Array, refs: dict, max_class: float, max_word: float, min_chars: int, min_words: int) -> list[pa.Array]:
    """The FIELDS of a batch of texts."""
    table = _class_table()
    data, offsets = B.buffer_of(texts)
    words = B.Words(data, offsets)
    counts = _byte_counts(data, offsets)
    classes = counts @ table
    lead = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])
    word_chars = counts[:, lead & ~B.SPACE].sum(axis=1)
    symbols = counts[:, np.frombuffer(SYMBOLS, np.uint8)].sum(axis=1)
    repeat, dup = _repeats(words), _dup_lines(words)
    n_words = words.counts.astype(np.int64)
    failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    n = len(n_words)
    chars = classes.sum(axis=1)
    long_enough = (chars >= min_chars) & (n_words >= min_words)
    best = np.full(n, np.inf)
    class_d, word_d, near = np.zeros(n), np.zeros(n), np.full(n, -1)
    value, doc = _word_keys(words), np.repeat(np.arange(n), words.counts)
    names = list(refs)
    for k, lang in enumerate(names):
        ref_class, keys, ref_words = refs[lang]
        at = np.searchsorted(keys, value)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == value[hit]
        hist = np.bincount(doc[hit] * (len(keys) + 1) + at[hit], minlength=n * (len(keys) + 1)).reshape(n, -1).astype(float)
        hist[:, -1] = n_words - hist[:, :-1].sum(axis=1)
        wd = js_distance(hist / np.maximum(n_words, 1)[:, None], ref_words)
        cd = js_distance(classes / np.maximum(chars, 1)[:, None], ref_class)
        closer = wd + cd < best
        best = np.where(closer, wd + cd, best)
        class_d, word_d, near = np.where(closer, cd, class_d), np.where(closer, wd, word_d), np.where(closer, k, near)
    diverges = long_enough & ((class_d > max_class) | (word_d > max_word))
    lang_names = pa.array([names[k] if k >= 0 and long_enough[i] else None for i, k in enumerate(near)], pa.string())
    none = ~(long_enough & (near >= 0))
    return [
        *(pa.array(x, pa.int64()) for x in (n_words, word_chars, symbols, dup, repeat)),
        pa.array(failed), pa.array(~(failed | diverges)),
        pa.array(class_d, mask=none), pa.array(word_d, mask=none), lang_names,
    ]


def assess(df: DataFrame, refs: dict, text_col: str = "text", returned: list[str] | None = None,
           max_class: float = 0.28, max_word: float = 0.42, min_chars: int = 200, min_words: int = 40) -> DataFrame:
    """The returned columns of df (default: all) with FIELDS.

    Base rule: fewer than 20 words, or over 30 % of them in repeated 8-word windows. The method's verdict: farther
    from the nearest reference than max_class or max_word (Jensen-Shannon distances), judged only from min_chars
    characters and min_words words on; below, and without references, nothing diverges. Null
    and empty texts have no words and fail. Each row is judged by itself; input columns named like an added one are replaced.
    """
    df = without(df, [name for name, _ in FIELDS])
    returned = [c for c in (returned or df.columns) if c in df.columns]
    columns = list(dict.fromkeys([*returned, text_col]))
    fields = [df.schema[c] for c in returned] + [T.StructField(*f) for f in FIELDS]

    def run(batches):
        B.claim("quality_rules")
        for batch in B.slices(batches, text_col):
            got = measure(batch.column(columns.index(text_col)), refs, max_class, max_word, min_chars, min_words)
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in returned] + got, [f.name for f in fields])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of assess() over documents."""
    return assess(docs.select("doc_id", "text"), references(docs), returned=["doc_id"])

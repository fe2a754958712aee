"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of KERNEL bytes slide with STRIDE over the whole document, and each
filter's responses are max-pooled in overlapping chunks. A document's features are the maximum
and the mean over all its chunks; one logistic unit makes a probability of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from . import bytescan as B
from .langid import held_out, sample_rows, thinned
from .storage import without

EMBED, FILTERS = 8, 16
STRIDE, KERNEL = 4, 8
#: Positions in a block; a chunk is CHUNK blocks, and chunks begin STEP blocks apart.
BLOCK, CHUNK, STEP = 32, 4, 3
#: Labelled documents to learn from, of each label, the bytes they may have together, and passes over them; documents are learned whole.
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS = 800, 4_000_000, 8
#: Documents and bytes in a training batch; a longer document is a batch of its own.
BATCH, BATCH_BYTES = 32, 200_000


@dataclass
class Net:
    embed: np.ndarray   # 256 x EMBED
    left: np.ndarray    # STRIDE * EMBED x FILTERS, for the bytes before a position
    right: np.ndarray   # the same for the bytes after it
    bias: np.ndarray    # FILTERS
    out: np.ndarray     # 2 * FILTERS
    shift: np.ndarray   # 1


def _fresh(seed: int) -> Net:
    r = np.random.default_rng(seed)
    return Net(
        (r.normal(size=(256, EMBED)) * 0.5).astype(np.float32),
        (r.normal(size=(STRIDE * EMBED, FILTERS)) * 0.15).astype(np.float32),
        (r.normal(size=(STRIDE * EMBED, FILTERS)) * 0.15).astype(np.float32),
        np.full(FILTERS, 0.1, np.float32), (r.normal(size=2 * FILTERS) * 0.1).astype(np.float32), np.zeros(1, np.float32),
    )


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from STRIDE on, each padded with zeros to whole blocks, and the number of blocks before each.

    A filter at a position sees the STRIDE bytes on each side; every text ends in STRIDE zeros at least.
    """
    size = np.diff(offsets)
    unit = BLOCK * STRIDE
    blocks = (size + STRIDE + unit - 1) // unit
    before = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(STRIDE + int(before[-1]) * unit, np.uint8)
    for i in range(len(size)):
        if size[i]:
            at = STRIDE + before[i] * unit
            out[at:at + size[i]] = data[offsets[i]:offsets[i + 1]]
    return out, before


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First block within its text and text of each chunk, and the number of chunks before each text."""
    n = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
    before = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(blocks)), n)
    return (np.arange(len(text)) - before[text]) * STEP, text, before


def _forward(net: Net, data: np.ndarray, offsets: np.ndarray):
    raw, before = _laid_out(data, offsets)
    quads = net.embed[raw].reshape(-1, STRIDE * EMBED)
    response = quads[:-1] @ net.left
    response += quads[1:] @ net.right
    by_block = response.reshape(-1, BLOCK, FILTERS)
    tops = by_block.max(axis=1)
    first, text, chunks_before = _chunks(np.diff(before))
    last = before[1:][text] - 1
    at = np.minimum((before[:-1][text] + first)[:, None] + np.arange(CHUNK), last[:, None])
    top = np.maximum(tops[at].max(axis=1) + net.bias, 0)
    starts = chunks_before[:-1]
    n = np.diff(chunks_before)[:, None]
    best = np.maximum.reduceat(top, starts, axis=0) if len(starts) else np.zeros((0, FILTERS), np.float32)
    mean = np.add.reduceat(top, starts, axis=0) / n if len(starts) else best
    features = np.concatenate([best, mean], axis=1)
    logit = features @ net.out + net.shift[0]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (raw, quads, by_block, tops, at, top, starts, n, best, features, text)


def probabilities(net: Net, texts: pa.Array) -> np.ndarray:
    return _forward(net, *B.buffer_of(texts))[0].astype(np.float64)


def _gradients(net: Net, kept, error: np.ndarray) -> Net:
    raw, quads, by_block, tops, at, top, starts, n, best, features, text = kept
    g_feature = error[:, None] * net.out
    g_top = (g_feature[:, FILTERS:] / n)[text]
    is_best = top == best[text]
    share = np.add.reduceat(is_best, starts, axis=0, dtype=np.int64)
    g_top = (g_top + g_feature[:, :FILTERS][text] * is_best / share[text]) * (top > 0)
    chunk, f = np.nonzero(g_top)
    g = g_top[chunk, f].astype(np.float32)
    block = at[chunk, tops[at[chunk], f[:, None]].argmax(axis=1)]
    place = block * BLOCK + by_block[block, :, f].argmax(axis=1)
    left, right = quads[place], quads[place + 1]
    d_left, d_right = np.zeros_like(net.left), np.zeros_like(net.right)
    for k in range(FILTERS):
        own = f == k
        d_left[:, k] = g[own] @ left[own]
        d_right[:, k] = g[own] @ right[own]
    d_embed = np.zeros_like(net.embed)
    for weights, here in ((net.left, place), (net.right, place + 1)):
        d_quad = (g[:, None] * weights.T[f]).reshape(-1, STRIDE, EMBED)
        np.add.at(d_embed, raw.reshape(-1, STRIDE)[here], d_quad)
    return Net(d_embed, d_left, d_right, np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32), error @ features, np.array([error.sum()]))


def _batches(order: np.ndarray, size: np.ndarray):
    held: list[int] = []
    for k in order.tolist():
        if held and (len(held) == BATCH or size[held].sum() + size[k] > BATCH_BYTES):
            yield np.array(held)
            held = []
        held.append(k)
    if held:
        yield np.array(held)


def train(texts: list[str], labels: list[int], seed: int = 3) -> Net:
    """Fit a net by Adam on shuffled batches; the labels weigh alike. One label alone fixes the bias only."""
    net, r = _fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.shift[0] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    size = np.array([len(t.encode()) for t in texts])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ("embed", "left", "right", "bias", "out", "shift")
    one, two, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(EPOCHS):
        for pick in _batches(r.permutation(len(y)), size):
            p, kept = _forward(net, *B.buffer_of(pa.array([texts[k] for k in pick], pa.string())))
            grad = _gradients(net, kept, ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32))
            t += 1
            for k in names:
                d = getattr(grad, k)
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.99 * two[k] + 0.01 * d * d
                rate = 0.01 * (1 - epoch / EPOCHS) * one[k] / (1 - 0.9**t) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-7)
                setattr(net, k, (getattr(net, k) - rate).astype(np.float32))
    return net


def learn(df: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """A net fit to whole texts of at most `rows` documents and sample_bytes of each label, of ids that are not held out.

    Documents without label or text teach nothing; an id's texts, and its labels if they differ, are one document each.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("group"))
    marked = thinned(marked.distinct().withColumn("h", F.xxhash64(F.lit(13), "id")), rows)
    order = Window.partitionBy("group").orderBy("h", "id")
    chosen = marked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("id", "group")
    texts = df.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    got = sample_rows(texts.join(F.broadcast(chosen), "id"), rows, sample_bytes, 13, thin=False)  # rows a label at most are broadcast
    return train([text for _, text in got], [label for label, _ in got])


FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType())]


def score(df: DataFrame, net: Net, threshold: float = 0.3, text_col: str = "text", returned: list[str] | None = None) -> DataFrame:
    """The returned columns of df (default: all) with FIELDS; input columns named like those are replaced.

    Whole texts of any length, each by itself, so copies score alike and scores that tie are equal; null and empty texts get the
    score of an empty text, an empty table gives no rows. predicted: 1 from threshold on.
    """
    df = without(df, [name for name, _ in FIELDS])
    returned = [c for c in (returned or df.columns) if c in df.columns]
    columns = list(dict.fromkeys([*returned, text_col]))
    fields = [df.schema[c] for c in returned] + [T.StructField(*f) for f in FIELDS]

    def run(batches):
        B.claim("quality_model")
        for batch in B.slices(batches, text_col, 1_000_000):
            p = probabilities(net, batch.column(columns.index(text_col)))
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in returned] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], [f.name for f in fields])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of score() over documents."""
    return score(docs.select("doc_id", "text"), learn(docs, labels), returned=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")

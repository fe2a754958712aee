"""Language identification by cross-parsing.

For each language a suffix automaton of sample text (letters lower-cased, all else a space,
as bytes) is built on the driver. A text is parsed greedily into the longest phrases that the sample holds; the
language with the fewest phrases for the text's length wins. The automata are flat transition tables. Texts are cut into
segments that are parsed in step, one table look-up a byte and language; where a segment's parse began amid a phrase,
its first phrases are then parsed again from the state in which the segment before it ended, so that counts are those of whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from . import bytescan as B
from .storage import without

#: Rows of each language that may be learned from, and the bytes that they may have together; a row is learned whole or not at all.
SAMPLE_ROWS, SAMPLE_BYTES = 64, 32_000
#: Bytes of a text that are parsed in step with other texts' bytes.
SEGMENT = 1024
#: Bytes of texts that a worker parses at a time.
SLICE_BYTES = 1_500_000
#: Bytes of transition tables held at a time.
TABLE_BYTES = 128 << 20


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 5 = 0; a row without id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def thinned(df: DataFrame, rows: int) -> DataFrame:
    """df (group, h, ...) with about 4 rows of each group for each of `rows`, those whose hash h ends in a small number; a group keeps one at least."""
    end = F.pmod("h", F.lit(1 << 30))
    counts = df.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("least")).collect()
    limits = [(r["group"], max(int(min(1.0, 4.0 * rows / r["n"]) * (1 << 30)), r["least"] + 1)) for r in counts]
    kinds = T.StructType([T.StructField("group", df.schema["group"].dataType), T.StructField("limit", T.LongType())])
    few = F.broadcast(df.sparkSession.createDataFrame(limits, kinds))  # a row a group
    return df.join(few, "group").where(end < F.col("limit")).drop("limit")


def sample_rows(df: DataFrame, rows: int, max_bytes: int, seed: int = 7, thin: bool = True) -> list[tuple]:
    """(group, text) of at most `rows` rows of each group of df (group, id, text), whole texts of max_bytes together at most.

    Rows come in the order of a seeded hash of id and text, such as are longer than max_bytes last and then by length; a group of
    none but those gives the shortest one. All rows are hashed; about four times `rows` keys of a group are then put in order, unless
    df is small already (thin=False). Texts are read in a last pass.
    """
    own = df.where("group is not null and text is not null").withColumn("h", F.xxhash64(F.lit(seed), "id", "text")).withColumn("size", F.octet_length("text"))
    order = Window.partitionBy("group").orderBy(F.greatest(F.col("size") - max_bytes, F.lit(0)), "h")
    keys = own.select("group", "h", "size")
    keys = (thinned(keys, rows) if thin else keys).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).collect()
    chosen, used = {}, {}
    for k in sorted(keys, key=lambda k: k["nth"]):
        if k["group"] not in used or used[k["group"]] + k["size"] <= max_bytes:
            if (k["group"], k["h"]) not in chosen:
                used[k["group"]] = used.get(k["group"], 0) + k["size"]
                chosen[k["group"], k["h"]] = k["nth"]
    if not chosen:
        return []
    picked = df.sparkSession.createDataFrame(list(chosen), T.StructType([T.StructField("group", df.schema["group"].dataType), T.StructField("h", T.LongType())]))
    texts = own.join(F.broadcast(picked), ["group", "h"]).groupBy("group", "h").agg(F.min("text").alias("text")).collect()  # rows keys a group at most
    return [(r["group"], r["text"]) for r in sorted(texts, key=lambda r: chosen[r["group"], r["h"]])]


#: Bytes as they are parsed: A-Z in lower case, all other ASCII but letters a space.
_PLAIN = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are parsed: letters lower-cased (ASCII and Latin-1), runs of all else one space."""
    if not len(data):
        return data, offsets
    out = _PLAIN[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 0x20
    keep = np.ones(len(out), np.bool_)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(_per_text(keep, offsets))])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
    return out


class Automaton:
    """Suffix automaton of a byte string over symbol numbers."""

    def __init__(self, symbols: np.ndarray):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.states = len(nxt)
        self.source = np.repeat(np.arange(len(nxt), dtype=np.int32), [len(to) for to in nxt])
        self.symbol = np.array([c for to in nxt for c in to], np.uint8)
        self.target = np.array([s for to in nxt for s in to.values()], np.int32)

    def table(self, width: int) -> np.ndarray:
        """next state * width * 2, plus 1 where a phrase begins, at state * width + symbol."""
        n = int(np.searchsorted(self.source, 1))  # of the root
        root = np.ones(width, np.int32)
        root[self.symbol[:n]] = self.target[:n] * (width * 2) + 1
        out = np.tile(root, (self.states, 1))
        out[self.source[n:], self.symbol[n:]] = self.target[n:] * (width * 2)
        return out.ravel()


class Model:
    """languages in order of name, symbol number of each byte, one automaton for each language.

    The automata are kept and sent as lists of transitions, less than 1 MB a language. Their tables are made for blocks of
    languages of at most table_bytes; if there is but one block its tables are kept.
    """

    def __init__(self, samples: dict[str, bytes], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(samples)
        raw = {k: plain(np.frombuffer(v, np.uint8), np.array([0, len(v)]))[0] for k, v in samples.items()}
        seen = np.unique(np.concatenate(list(raw.values()))) if raw else np.zeros(0, np.uint8)
        self.symbol = np.full(256, min(len(seen), 255), np.uint8)  # the last symbol is in no sample
        self.symbol[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        self.automata = [Automaton(self.symbol[raw[k]]) for k in self.languages]
        self.blocks, used = [], 0
        for k, a in enumerate(self.automata):
            size = a.states * self.width * 4
            if not self.blocks or used + size > table_bytes:
                self.blocks.append([])
                used = 0
            self.blocks[-1].append(k)
            used += size
        self._kept = None
        #: Bits that point out a phrase in a sample of this length.
        self.bits = np.array([math.log2(max(2, len(raw[k]))) for k in self.languages])

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    def tables(self, block: list[int]) -> list[np.ndarray]:
        """The tables of a block's languages."""
        if self._kept is not None:
            return self._kept
        out = [self.automata[k].table(self.width) for k in block]
        if len(self.blocks) == 1:
            self._kept = out
        return out

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each whole text, one column a language."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[:-1][doc] + nth * SEGMENT
        lengths = np.minimum(SEGMENT, offsets[1:][doc] - starts)
        order = np.argsort(-lengths, kind="stable")
        falling, first = lengths[order], starts[order]
        symbols = self.symbol[data]
        active = len(lengths) - np.searchsorted(falling[::-1], np.arange(SEGMENT), side="right")
        out = np.zeros((len(size), len(self.languages)), np.int64)
        for block in self.blocks:
            tables = self.tables(block)
            state = [np.zeros(len(starts), np.int32) for _ in tables]
            begun = [np.zeros(len(starts), np.int32) for _ in tables]
            for t in range(int(falling[0]) if len(falling) else 0):
                n = active[t]
                here = symbols[first[:n] + t]
                for k, table in enumerate(tables):
                    got = table[state[k][:n] + here]
                    begun[k][:n] += got & 1
                    np.right_shift(got, 1, out=state[k][:n])
            for k, lang in enumerate(block):
                ended, counted = np.empty_like(state[k]), np.empty_like(begun[k])
                ended[order], counted[order] = state[k], begun[k]
                counted += self._carried(tables[k], symbols, starts, lengths, nth, ended)
                out[:, lang] = np.bincount(doc, weights=counted, minlength=len(size))
        return out

    @staticmethod
    def _carried(table: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, nth: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """What to add to each segment's phrases, counted from the root, to have those of the parse that runs on from the segment before.

        ended: the state at each segment's end when parsed from the root. Two parses that reach one state are one from there
        on, mostly after a phrase or two; where they do not meet within a segment, the next one is parsed again from its true state.
        """
        own, more = ended.copy(), np.zeros(len(starts), np.int64)
        todo = np.flatnonzero(nth > 0)
        while len(todo):
            lane, true, root = np.arange(len(todo)), ended[todo - 1], np.zeros(len(todo), np.int32)
            final, diff = own[todo], np.zeros(len(todo), np.int64)
            for t in range(int(lengths[todo].max())):
                if t % 8 == 0:
                    lane_open = true != root
                    lane, true, root = lane[lane_open], true[lane_open], root[lane_open]
                    if not len(lane):
                        break
                over = lengths[todo[lane]] <= t
                if over.any():
                    final[lane[over]] = true[over]
                    lane, true, root = lane[~over], true[~over], root[~over]
                here = symbols[starts[todo[lane]] + t]
                one, two = table[true + here], table[root + here]
                diff[lane] += (one & 1) - (two & 1)
                true, root = one >> 1, two >> 1
            final[lane] = true
            more[todo] = diff
            changed = todo[final != ended[todo]]
            ended[todo] = final
            after = changed + 1
            after = after[after < len(starts)]
            todo = after[nth[after] > 0]
        return more

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of each text.

        score: the second-best language's normalised phrases over those and the best one's (1/2 to 1); 1 if there is but
        one language. Null texts and such without letters are `und` with score 0; ties go to the first name.
        """
        data, offsets = B.buffer_of(texts)
        letter = np.zeros(256, np.bool_)
        letter[[*range(65, 91), *range(97, 123)]] = True
        named = _per_text(letter[data], offsets) > 0
        for i in np.flatnonzero(~named & (np.diff(offsets) > 0)):
            named[i] = any(c.isalpha() for c in bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
        if not self.languages:
            return ["und"] * len(named), np.zeros(len(named)), np.zeros(len(named))
        data, offsets = plain(data, offsets)
        size = np.maximum(np.diff(offsets), 1)
        cost = self.phrases(data, offsets) * self.bits / size[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(size)), best]
        if len(self.languages) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = second / np.maximum(low + second, 1e-12)
        else:
            score = np.ones(len(size))
        score = np.where(named, np.clip(score, 0, 1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, named)], score, low


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of all languages of the rows that are not held out, from whole texts of at most `rows` rows and sample_bytes each.

    A language all of whose sampled rows are longer is learned from the shortest of them. Rows without text or language teach nothing; without
    labelled rows the model knows no language.
    """
    own = df.where(~held_out(id_col) & (F.length(F.col(f"`{text_col}`")) > 0))
    own = own.select(F.col(f"`{lang_col}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    samples: dict[str, list[bytes]] = {}
    for lang, text in sample_rows(own, rows, sample_bytes):
        samples.setdefault(lang, []).append(text.encode())
    return Model({lang: b"\n".join(texts) for lang, texts in samples.items()})


FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]


def identify(df: DataFrame, model: Model, text_col: str = "text", returned: list[str] | None = None) -> DataFrame:
    """The returned columns of df (default: all) with FIELDS; input columns named like those are replaced.

    Whole texts are parsed. The prediction sees the text alone, row by row: copies get the same answer, an empty table gives none.
    """
    df = without(df, [name for name, _ in FIELDS])
    returned = [c for c in (returned or df.columns) if c in df.columns]
    columns = list(dict.fromkeys([*returned, text_col]))
    fields = [df.schema[c] for c in returned] + [T.StructField(*f) for f in FIELDS]
    shared = df.sparkSession.sparkContext.broadcast(model)  # about 1 MB a language, bounded by the sample's bytes

    def run(batches):
        B.claim("langid")
        known = shared.value
        for batch in B.slices(batches, text_col, SLICE_BYTES):
            lang, score, bits = known.predict(batch.column(columns.index(text_col)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(columns.index(c)) for c in returned] + [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], [f.name for f in fields])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of identify() over documents."""
    return identify(docs.select("doc_id", "text"), learn(docs), returned=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")

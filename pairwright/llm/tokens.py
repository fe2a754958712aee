"""Token ids of many texts at once, each distinct word tokenized but once a worker.

For tokenizers that split at white space before all else, a text's ids are its words' ids one after the other.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import bytescan as B

#: Words known at a time; beyond it a worker starts anew (about 50 MB).
MAX_WORDS = 1_200_000
#: Words tokenized at a time; the tokenizer's objects take about a kilobyte each.
AT_ONCE = 20_000
#: Words in one call's text.
JOINED = 50


class WordTokenizer:
    """Ids of texts by a tokenizers file; the words' ids are kept between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip)]
        self.mark = special[0] if special else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _entries(self, words: B.Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The entry of each distinct hash; first: a word that has it."""
        if len(self.hashes) > MAX_WORDS:
            self._forget()
        out, order = np.empty(len(hashes), np.int32), np.argsort(hashes)
        hashes, first = hashes[order], first[order]  # in order, searches touch memory in order
        where = np.searchsorted(self.hashes, hashes)
        at = np.minimum(where, max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), np.bool_)
        out[order[known]] = self.entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data, sizes, flat = words.data.tobytes(), [], []
            for i in range(0, len(new), AT_ONCE):
                at = first[new[i:i + AT_ONCE]]
                texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())]
                own = self._ids(texts)
                sizes.append(own[0])
                flat.append(own[1])
            sizes = np.concatenate(sizes)
            entries = (len(self.begin) + np.arange(len(new))).astype(np.int32)
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, *flat])
            self.hashes, self.entry = np.insert(self.hashes, where[new], hashes[new]), np.insert(self.entry, where[new], entries)
            out[order[new]] = entries
        return out

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them.

        Words are joined by a special token, which parts texts before all else, and parted at its id again; a word that holds one by
        itself makes the number of parts differ, and then each is tokenized alone.
        """
        if self.mark:
            number, mark = self.mark
            joined = [mark.join(words[i:i + JOINED]) + mark for i in range(0, len(words), JOINED)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(flat == number)
            if len(ends) == len(words):
                return np.diff(ends, prepend=-1).astype(np.int32) - 1, np.delete(flat, ends)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return sizes, np.fromiter((t for x in ids for t in x), np.uint32, int(sizes.sum()))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids and len + 1 offsets; each text's ids are followed by `end` if given."""
        words = B.Words(*B.buffer_of(texts))
        coded = pa.array(words.hashes()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        entry = self._entries(words, distinct, first)[code] if len(code) else np.zeros(0, np.int64)
        sizes = self.size[entry]
        cum = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.repeat(self.begin[entry] - cum[:-1], sizes)
        at += np.arange(cum[-1])
        flat = self.pool[at]
        offsets = cum[words.first]
        if end is None:
            return flat, offsets
        n = len(offsets) - 1
        out = np.full(len(flat) + n, end, np.uint32)
        keep = np.ones(len(out), np.bool_)
        keep[offsets[1:] + np.arange(n)] = False
        out[keep] = flat
        return out, offsets + np.arange(n + 1)

"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow string array.

A batch is cut into slices of half a MB of whole texts, so that memory does not follow the batch;
one text longer than that is a slice of its own. Hashing goes block by block, so a long text needs about 3 bytes a
byte for marks and some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Odd 64-bit multipliers for the polynomial word hash and its finaliser.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

#: ``[^\x20\x09-\x0D]``, by byte: bytes of multi-byte characters are all at least 0x80.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes that begin a character, and A-Z lower-cased.
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1024


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends texts to Python in batches that stay small where texts are long.

    Plans read the setting when they run, so it stays with the session; a smaller one of the caller's is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that near inputs give unrelated values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` in 64 bits."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


#: Bytes that word hashes take at once; a longer text is hashed block by block.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse."""
    return powers(BASE, BLOCK), powers(UNBASE, BLOCK)


def free_name(docs: DataFrame, stem: str = "_helper") -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


@dataclass
class Slice:
    """Texts ``first`` to ``first + n`` of a batch: their bytes, and where each word starts and ends.

    ``text_at`` has n + 1 byte offsets, ``word_at`` n + 1 word offsets.
    """

    first: int
    n: int
    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray

    def counts(self, by_byte: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are marked."""
        out, full = np.zeros(self.n, np.int64), np.diff(self.text_at) > 0
        if full.any():
            out[full] = np.add.reduceat(by_byte, self.text_at[:-1][full], dtype=np.int64)
        return out

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by differences of a running polynomial over blocks of words."""
        out, first = np.zeros(len(self.starts), np.uint64), 0
        while first < len(out):
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + BLOCK, side="right")))
            if self.ends[first] - begin > BLOCK:
                out[first] = self._long_word(int(begin), int(self.ends[first]))
            else:
                starts, ends = self.starts[first:last] - begin, self.ends[first:last] - begin
                up, down = _powers()
                total = np.zeros(ends[-1] + 1, np.uint64)
                np.cumsum((self.data[begin : begin + ends[-1]].astype(np.uint64) + np.uint64(1)) * up[: ends[-1]], out=total[1:])
                # The difference holds the word times BASE**start, which its inverse takes away.
                out[first:last] = (total[ends] - total[starts]) * down[starts]
            first = last
        return mixed(out)

    def _long_word(self, begin: int, end: int) -> np.uint64:
        """The polynomial of one word that is longer than a block."""
        value = 0
        for at in range(begin, end, BLOCK):
            part = self.data[at : min(at + BLOCK, end)].astype(np.uint64) + np.uint64(1)
            value += int((part * _powers()[0][: len(part)]).sum()) * pow(BASE, at - begin, 1 << 64)
        return np.uint64(value % (1 << 64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` words in a row inside one text, and n + 1 window offsets."""
        words = np.diff(self.word_at)
        each = np.maximum(words - width + 1, 0)
        at = np.concatenate([[0], np.cumsum(each)])
        if not at[-1]:
            return np.zeros(0, np.uint64), at
        run = len(hashes) - width + 1
        value = hashes[:run].copy()
        for k in range(1, width):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(BASE) + hashes[k : k + run]
        # Windows that begin among a text's last width-1 words would cross into the next one.
        begin = np.repeat(self.word_at[:-1] - at[:-1], each) + np.arange(at[-1])
        return mixed(value[begin]), at


def slices(texts: pa.Array, kept: np.ndarray = NOT_SPACE, lower: bool = False, limit: int = 1 << 19) -> Iterator[Slice]:
    """Slices of whole texts of about ``limit`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    everything = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        data = everything[at[first] : at[last]]
        if lower:
            data = LOWER[data]
        text_at = at[first : last + 1] - at[first]
        inside = kept[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = text_at[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            starts[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        yield Slice(first, last - first, data, text_at, starts, ends, np.searchsorted(starts, text_at))
        first = last

"""Packing into fixed sequences as vector bin packing.

Every item asks for tokens, one segment and its loss-bearing tokens; a sequence bounds all three.
Sequences are filled one after another: of the waiting items that fit, the one whose demands have
the largest dot product with what is left goes in. Items may be cut where the caller allows it;
then a sequence into which nothing fits whole takes the head of an item. Each input partition
packs for itself with a bounded number of waiting items, so there is no shuffle, memory does not follow the
input, and where items may be cut at most one sequence per partition is left short.

Defined results: a null or empty text is its end id alone; rows are packed one by one, whatever
their ids (a repeated or null id is a row like any other); an item over a limit that may not be cut
has no sequence (null); an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import MARKS, SPACE, token_counts
from .tokenizer_files import tokenizer_path
from .words import in_small_batches, slices


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. In a partition more than half of ``waiting`` items wait, or ``reserve`` sequences' tokens, so that tiny items never close a short sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    waiting: int = 512
    reserve: int = 4


class Bins:
    """Items that wait, as rows of demands, and the sequences made of them."""

    def __init__(self, limits: Limits, cut: bool) -> None:
        self.limits, self.may_cut = limits, cut
        self.full = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.items: list[object] = []
        self.demands = np.zeros((0, 3), np.int64)

    def add(self, items: list[object], demands: np.ndarray) -> None:
        self.items += items
        self.demands = np.concatenate([self.demands, demands])

    def fill(self, last: bool) -> Iterator[list[tuple[object, int]]]:
        """Sequences as lists of (item, tokens taken), while more wait than half of ``waiting`` items and ``reserve`` sequences' tokens; with ``last`` all.

        Of a cut item the head is taken; its tokens without loss come first, and what waits on is the same item with smaller demands.
        """
        scale = 1.0 / self.full
        alive = np.ones(len(self.items), bool)
        weighted = self.demands * scale
        left_over, tokens = len(self.items), int(self.demands[:, 0].sum())
        while left_over and (last or (left_over > self.limits.waiting // 2 and tokens > self.limits.reserve * self.limits.tokens)):
            room = self.full.copy()
            made: list[tuple[object, int]] = []
            while left_over and room[0] and room[1]:
                value = np.where(alive, weighted @ (room * scale), -1.0)
                fits = np.where((self.demands <= room).all(axis=1), value, -1.0)
                best = int(np.argmax(fits))
                if fits[best] >= 0:
                    room -= self.demands[best]
                    tokens -= int(self.demands[best, 0])
                    made.append((self.items[best], int(self.demands[best, 0])))
                    alive[best] = False
                    left_over -= 1
                    continue
                if not self.may_cut:
                    break
                best = int(np.argmax(value))
                free = int(self.demands[best, 0] - self.demands[best, 2])
                head = int(min(room[0], room[2] + free))
                if not head:
                    break
                made.append((self.items[best], head))
                tokens -= head
                self.demands[best, 0] -= head
                self.demands[best, 2] -= max(0, head - free)
                weighted[best] = self.demands[best] * scale
                break
            yield made
        keep = np.flatnonzero(alive)
        self.items = [self.items[k] for k in keep]
        self.demands = self.demands[keep]


class Ids:
    """Token ids as little-endian 32-bit bytes; remembers at most ``limit`` chunks between white space."""

    def __init__(self, path: str, limit: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool, self.limit = Tokenizer.from_file(path), limit
        self.chunk = re.compile(rf"[^{SPACE}]+")
        self.known: dict[str, bytes] = {}
        vocab = self.tool.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[k for word, k in vocab.items() if word.endswith("</w>")]] = True

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. White space separates tokens and makes none, so chunks stand for themselves.

        The vocabulary lower-cases; doing so for A-Z first lets forms of a word share an entry. Texts that may hold special
        tokens, which are matched before that, stay as they are.
        """
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self.chunk.findall((t if b"<|" in t else t.lower()).decode()) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]

    def learn(self, chunks: list[str]) -> None:
        """Add chunks. A run of letters and the mark that follows it are tokenised apart, so the run is asked for once.

        That holds where the run still ends in a letter once normalised: some letters become one and a combining mark, which joins what follows.
        """
        known = self.known
        marked = [(c, c[:-1], c[-1]) for c in chunks if c[-1] in MARKS and c[:-1].isalpha() and self.ends_in_letter(c[:-1])]
        ends = {c for c, _, _ in marked}
        plain = {c for c in chunks if c not in ends}
        asked = plain.union([w for _, w, _ in marked]).difference(known)
        words = [w for w in asked if w.isalpha()]
        others = [c for c in asked.union(MARKS).difference(known) if not c.isalpha()]
        for k in range(0, len(words), 1024):
            others += self.learn_words(words[k : k + 1024])
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            for chunk, found in zip(some, self.tool.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[chunk] = array("I", found.ids).tobytes()
        known.update([(c, known[w] + known[m]) for c, w, m in marked])

    def ends_in_letter(self, word: str) -> bool:
        return word[-1].isascii() or self.tool.normalizer.normalize_str(word)[-1:].isalpha()

    def learn_words(self, words: list[str]) -> list[str]:
        """Add runs of letters by one call: each ends with the only id of it that ends a word. Returns them if that does not hold."""
        found = np.array(self.tool.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends_word[found]) + 1
        if len(last) != len(words):
            return words
        raw, at = found.tobytes(), [0, *(4 * last).tolist()]
        self.known.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        return []


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)


#: The id that ends each document.
END = np.array([1], "<u4").tobytes()

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, n_segments bigint"


class _Document:
    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, 0, len(ids) // 4


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """Cut and pack the token ids of whole texts; one row per piece.

    Every id bears loss but a document's first, which nothing foretells. Whole sequences are taken off the front of long documents first;
    the rests wait and are packed under all three limits, and cut once more where nothing fits whole.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, bins = ids(path), Bins(limits, cut=True)
        number = TaskContext.get().partitionId() << 33
        out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}

        def piece(doc: _Document, take: int, offset: int, segments: int) -> None:
            body = doc.ids[4 * doc.start : 4 * (doc.start + take)]
            for name, value in zip(out, (doc.doc_id, doc.start, take, zlib.crc32(body), doc.total, number, offset, segments), strict=True):
                out[name].append(value)
            doc.start += take

        def close(last: bool) -> None:
            nonlocal number
            for made in bins.fill(last):
                offset = 0
                for doc, take in made:
                    piece(doc, take, offset, len(made))
                    offset += take
                number += 1

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in out.items()})
            for values in out.values():
                values.clear()
            return batch

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text")):
                raw, at = s.data.tobytes(), s.text_at
                rests = []
                for k, found in enumerate(tool.of([raw[at[k] : at[k + 1]] for k in range(s.n)])):
                    doc = _Document(doc_ids[s.first + k], found + END)
                    while (size := min(limits.tokens, limits.loss + (doc.start == 0))) <= doc.total - doc.start:
                        piece(doc, size, 0, 1)
                        number += 1
                    if doc.start < doc.total:
                        rests.append(doc)
                for k in range(0, len(rests), limits.waiting):
                    some = rests[k : k + limits.waiting]
                    rest = np.array([d.total - d.start for d in some], np.int64)
                    begun = np.array([d.start > 0 for d in some])
                    bins.add(some, np.stack([rest, np.ones_like(rest), rest - 1 + begun], axis=1))
                    close(False)
            if out["doc_id"]:
                yield flushed()
        close(True)
        yield flushed()

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(packed, PIECES)


EXAMPLES = "example_id bigint, n_tokens bigint, n_loss bigint, sequence_id bigint, offset bigint"


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack examples (``example_id``, ``n_tokens``, ``n_loss``) uncut, under all three limits.

    An example over a limit has a null sequence. Null counts are 0.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, number = Bins(limits, cut=False), TaskContext.get().partitionId() << 33

        def rows(last: bool) -> list[tuple]:
            nonlocal number
            found = []
            for made in bins.fill(last):
                offset = 0
                for (example, tokens, loss), _ in made:
                    found.append((example, tokens, loss, number, offset))
                    offset += tokens
                number += 1
            return found

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in EXAMPLES.split(", ")]
            return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in found], pa.int64()) for k, n in enumerate(names)})

        for batch in batches:
            every = list(zip(*(batch.column(n).to_pylist() for n in ("example_id", "n_tokens", "n_loss")), strict=True))
            every = [(e, t or 0, loss or 0) for e, t, loss in every]
            over = [(*x, None, None) for x in every if x[1] > limits.tokens or x[2] > limits.loss]
            every = [x for x in every if x[1] <= limits.tokens and x[2] <= limits.loss]
            found = over
            for k in range(0, len(every), limits.waiting):
                some = every[k : k + limits.waiting]
                bins.add(some, np.array([[t, 1, loss] for _, t, loss in some], np.int64))
                found += rows(False)
            yield batch_of(found)
        yield batch_of(rows(True))

    return examples.select("example_id", "n_tokens", "n_loss").mapInArrow(packed, EXAMPLES)


#: What a sequence of conversations holds: fewer segments and loss-bearing tokens than tokens.
CONVERSATIONS = Limits(tokens=2048, segments=16, loss=1536)


def pack_conversations(turns: DataFrame, limits: Limits = CONVERSATIONS) -> DataFrame:
    """Pack whole conversations (``conv_id, role, text``) uncut; only the assistant's tokens bear loss.

    Conversations are summed before they are packed, and packed in order of id inside a partition, so a repeated task gives the same
    sequences. Rows without a ``conv_id`` are one conversation; a null role bears no loss.
    """
    counted = token_counts(turns.select(F.struct("conv_id", "role").alias("doc_id"), "text"), path=tokenizer_path("byte_bpe_50k.json"))
    loss = F.when(F.col("doc_id.role") == "assistant", F.col("n_tokens")).otherwise(0)
    examples = counted.groupBy(F.col("doc_id.conv_id").alias("example_id")).agg(F.sum("n_tokens").alias("n_tokens"), F.sum(loss).alias("n_loss"))
    return pack_examples(examples.sortWithinPartitions("example_id"), limits)

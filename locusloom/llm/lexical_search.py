"""Ranked lexical search over bit-sliced Bloom signatures.

``index`` reads every document once and stores blocks of documents whose signatures have one length. A
block is kept slice by slice: row r is a bitmap of the documents whose signature has bit r. A document puts a term in
once for every step of ``STEPS`` that its count reaches, so the slices of (term, step), combined by AND, are
a bitmap of the documents that hold the term at least so often, and sometimes of one too many. The same
scan stores how many documents of its part hold each term.

``search`` adds, item by item, what each step adds to the score, weighted by the term: an upper bound for every document. The
``PROBE`` documents with the highest bounds are scored exactly; the last of the best ``top`` scores is the item's threshold. Where the
bounds of all others are below it the item is settled; else every document whose bound reaches it, none left out, is scored exactly.

Items are taken in blocks of at most ``ITEMS`` items and about ``TERMS`` different terms, so what is sent to the tasks has a bound.
Terms are compared by 64-bit hashes.

Defined results: null, empty and blank texts have no terms, are no documents of the collection and match nothing; rows are
ranked one by one, so repeated rows and texts under one id are ranked each, with a null ``doc_id`` last among equal scores; each row of the
items is an item, whatever its id; items without terms or matches have no rows; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from .words import BASE, in_small_batches, mixed, slices

#: Bytes of terms: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Slices asked for a (term, step), and bits for each of them at the block's largest document.
HASHES, BITS = 4, 12

#: Cells (documents times bits) after which a block is stored, and terms after which a part's counts are.
CELLS, COUNTED = 1 << 23, 1 << 20

#: Items and different terms of a block of items; documents scored exactly before a threshold is known.
ITEMS, TERMS, PROBE = 256, 1 << 14, 64

#: Candidate documents up to which their ids are sent to the scan of the texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000

#: Terms whose bitmaps are held as numbers at once.
_AT_ONCE = 2048


def _steps() -> np.ndarray:
    """Counts at which a term enters a signature again: every one up to 8, then a quarter more each."""
    found = list(range(1, 9))
    while found[-1] < 1 << 40:
        found.append(found[-1] + found[-1] // 4)
    return np.array(found, np.int64)


STEPS = _steps()

INDEX = "bits int, steps int, doc_ids array<bigint>, lengths array<bigint>, slices binary, terms binary, dfs binary, n_docs bigint, n_terms bigint"


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slices of each key, as rows of ``HASHES`` numbers."""
    first, step = keys >> np.uint64(32), keys | np.uint64(1)
    return np.stack([((first + np.uint64(k) * (step & np.uint64(0xFFFFFFFF))) % np.uint64(bits)).astype(np.int64) for k in range(HASHES)])


def _stepped(hashes: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    """Keys of (term, step)."""
    return mixed(hashes + (np.atleast_1d(step).astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, count) of every different pair, in order of hash and then owner; owners ascend in the input."""
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[begins], o[begins], np.diff(np.append(begins, len(h)))


class _Block:
    """Documents whose numbers of keys lie between a power of two and the next."""

    def __init__(self, size_class: int) -> None:
        self.bits = BITS << (size_class + 1)
        self.doc_ids: list = []
        self.lengths: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.columns: list[np.ndarray] = []
        self.steps = 0

    def row(self) -> dict:
        n = len(self.doc_ids)
        cells = np.zeros((self.bits, n), bool)
        keys, columns = np.concatenate(self.keys), np.concatenate(self.columns)
        for places in _places(keys, self.bits):
            cells[places, columns] = True
        lengths = np.concatenate(self.lengths)
        return {"bits": self.bits, "steps": self.steps, "doc_ids": self.doc_ids, "lengths": lengths.tolist(), "slices": np.packbits(cells, axis=1).tobytes(), "n_docs": n, "n_terms": int(lengths.sum())}


class _Builder:
    """Blocks and term counts of one part of the documents."""

    def __init__(self) -> None:
        self.blocks: dict[int, _Block] = {}
        self.terms: list[np.ndarray] = []
        self.dfs: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: list, hashes: np.ndarray, words: np.ndarray) -> None:
        """Add documents with their words' hashes; those without words are left out."""
        h, owner, tf = _counted(hashes, np.repeat(np.arange(len(words)), words))
        if not len(h):
            return
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.terms.append(h[begins])
        self.dfs.append(np.diff(np.append(begins, len(h))))
        self.held += len(begins)
        steps = np.searchsorted(STEPS, tf, side="right")
        step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        keys, owner = _stepped(np.repeat(h, steps), step), np.repeat(owner, steps)
        each = np.bincount(owner, minlength=len(words))
        classes = np.where(each > 0, np.frexp(np.maximum(each, 1))[1] - 1, -1)
        for c in np.unique(classes[classes >= 0]).tolist():
            block = self.blocks.setdefault(c, _Block(c))
            chosen = np.flatnonzero(classes == c)
            column = np.full(len(words), -1, np.int64)
            column[chosen] = len(block.doc_ids) + np.arange(len(chosen))
            mine = column[owner] >= 0
            block.doc_ids += [doc_ids[k] for k in chosen.tolist()]
            block.lengths.append(words[chosen])
            block.keys.append(keys[mine])
            block.columns.append(column[owner[mine]])
            block.steps = max(block.steps, int(step[mine].max()) + 1)

    def full(self, last: bool) -> Iterator[dict]:
        """Rows of what has reached its size; with ``last`` of all."""
        for c, block in list(self.blocks.items()):
            if last or len(block.doc_ids) * block.bits >= CELLS:
                yield self.blocks.pop(c).row()
        if self.held and (last or self.held >= COUNTED):
            terms, at = np.unique(np.concatenate(self.terms), return_inverse=True)
            dfs = np.bincount(at, weights=np.concatenate(self.dfs)).astype(np.int64)
            if last or 2 * len(terms) > COUNTED:
                yield {"terms": terms.tobytes(), "dfs": dfs.tobytes(), "n_docs": 0, "n_terms": 0}
                terms, dfs = terms[:0], dfs[:0]
            self.terms, self.dfs, self.held = [terms], [dfs], len(terms)


def index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures and the parts' term counts, as rows of ``INDEX``; stored, from one scan without a shuffle."""
    schema = pa.schema([("bits", pa.int32()), ("steps", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()), ("terms", pa.binary()), ("dfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder()

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            for row in builder.full(last):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text"), TERM_BYTES, lower=True):
                builder.add(doc_ids[s.first : s.first + s.n], s.word_hashes(), np.diff(s.word_at))
                yield from rows(False)
        yield from rows(True)

    return cut(in_small_batches(docs).select("doc_id", "text").mapInArrow(built, INDEX))


@dataclass(frozen=True)
class Items:
    """A block of items over one sorted array of term hashes: item k has ``counts[k]`` of the terms at ``terms[k]``."""

    ids: tuple
    hashes: np.ndarray
    terms: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]

    @staticmethod
    def of(rows: list[tuple[int | None, np.ndarray]]) -> Items:
        hashes = np.unique(np.concatenate([h for _, h in rows]))
        found = [np.unique(h, return_counts=True) for _, h in rows]
        return Items(tuple(i for i, _ in rows), hashes, tuple(np.searchsorted(hashes, h) for h, _ in found), tuple(n for _, n in found))


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items (``item_id``, ``text``) as bounded blocks; no more than one Spark partition of them is held."""
    held: list[tuple[int | None, np.ndarray]] = []
    terms = 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        (s,) = slices(pa.array([text], pa.string()), TERM_BYTES, lower=True)
        if not len(s.starts):
            continue
        hashes = s.word_hashes()
        different = len(np.unique(hashes))
        if held and (len(held) == ITEMS or terms + different > TERMS):
            yield Items.of(held)
            held, terms = [], 0
        held.append((item_id, hashes))
        terms += different
    if held:
        yield Items.of(held)


@dataclass(frozen=True)
class Weights:
    """The collection's documents and terms, and each term's weight."""

    n_docs: int
    n_terms: int
    of_term: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The length that scores are divided by: 25, and 75 for the mean length."""
        return 25 + (75 * n * self.n_docs) // self.n_terms


def part_of(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by, for its count and the document's length."""
    tf = np.asarray(tf, np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weights(built: DataFrame, items: Items) -> Weights:
    """Sizes of the collection and weights of the items' terms, from the stored counts."""
    hashes = items.hashes

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, dfs in zip(batch.column("terms"), batch.column("dfs"), strict=True):
                there, n = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(dfs.as_py(), np.int64)
                at = np.minimum(np.searchsorted(there, hashes), len(there) - 1)
                hit = np.flatnonzero(there[at] == hashes)
                yield pa.RecordBatch.from_pydict({"term": pa.array(hit, pa.int64()), "df": pa.array(n[at[hit]], pa.int64())})

    n_docs, n_terms = built.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    dfs = np.zeros(len(hashes), np.int64)
    for term, df in built.where("terms is not null").select("terms", "dfs").mapInArrow(found, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        dfs[term] = df
    n = n_docs or 0
    return Weights(n, n_terms or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in dfs.tolist()], np.int64))


def _bounds(matrix: np.ndarray, hashes: np.ndarray, w: Weights, bits: int, steps: int, lengths: np.ndarray, stored: bytes) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, items as rows; whole numbers below 2**53 are exact."""
    n = len(lengths)
    rows = np.frombuffer(stored, np.uint8).reshape(bits, -1)
    m, out = w.lengths(lengths), np.zeros((len(matrix), n))
    for first in range(0, len(hashes), _AT_ONCE):
        active = np.arange(first, min(first + _AT_ONCE, len(hashes)))
        there = np.full((len(active), rows.shape[1]), 255, np.uint8)
        for step in range(steps):
            for places in _places(_stepped(hashes[active], step), bits):
                there &= rows[places]
            some = there.any(axis=1)
            active, there = active[some], there[some]
            if not len(active):
                break
            # A document with the count of this step and not of the next has at most one less than the next.
            adds = part_of(STEPS[step + 1] - 1, m) - part_of(STEPS[step] - 1, m)
            out += (matrix[:, active] @ np.unpackbits(there, axis=1, count=n).astype(np.float64)) * adds
    return out


def _matrix(items: Items, w: Weights, chosen: list[int]) -> np.ndarray:
    """Weights of the items' terms, with repeats, as rows over all terms of the block."""
    out = np.zeros((len(chosen), len(items.hashes)))
    for row, k in enumerate(chosen):
        out[row, items.terms[k]] = w.of_term[items.terms[k]] * items.counts[k]
    return out


BOUNDS = "item int, doc_id bigint, bound double"


def _batch(item: np.ndarray, doc_id: list, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "bound": pa.array(bound, pa.float64())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in ("bits", "steps", "doc_ids", "lengths", "slices"))


def highest_bounds(built: DataFrame, items: Items, w: Weights, probe: int = PROBE) -> DataFrame:
    """``item, doc_id, bound`` of the ``probe`` documents with the highest bounds above 0; each task sends its own best on."""
    chosen = list(range(len(items.ids)))
    matrix, hashes = _matrix(items, w, chosen), items.hashes

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), []) for _ in chosen]
        for bits, steps, doc_ids, lengths, stored in _blocks(batches):
            bounds = _bounds(matrix, hashes, w, bits, steps, np.array(lengths, np.int64), stored)
            for k, row in enumerate(bounds):
                old, old_ids = held[k]
                least = old.min() if len(old) == probe else 0.0
                new = np.flatnonzero(row > least)
                if len(new):
                    both, ids = np.concatenate([old, row[new]]), [*old_ids, *[doc_ids[j] for j in new.tolist()]]
                    top = np.argsort(-both, kind="stable")[:probe]
                    held[k] = both[top], [ids[j] for j in top.tolist()]
        for k, (bounds, ids) in enumerate(held):
            if ids:
                yield _batch(np.full(len(ids), k, np.int32), ids, bounds)

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last()))
    stored = built.where("slices is not null").select("bits", "steps", "doc_ids", "lengths", "slices")
    return stored.mapInArrow(best, BOUNDS).withColumn("place", place).where(F.col("place") <= probe)


def reaching(built: DataFrame, items: Items, w: Weights, least: dict[int, int]) -> DataFrame:
    """``item, doc_id, bound`` of every document whose bound reaches its item's threshold, for the items in ``least``."""
    chosen = sorted(least)
    matrix, hashes = _matrix(items, w, chosen), items.hashes
    threshold = np.array([[max(1, least[k])] for k in chosen], np.float64)
    names = np.array(chosen, np.int32)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, steps, doc_ids, lengths, stored in _blocks(batches):
            bounds = _bounds(matrix, hashes, w, bits, steps, np.array(lengths, np.int64), stored)
            rows, columns = np.nonzero(bounds * (1 + 2.0**-40) >= threshold)
            yield _batch(names[rows], [doc_ids[j] for j in columns.tolist()], bounds[rows, columns])

    return built.where("slices is not null").select("bits", "steps", "doc_ids", "lengths", "slices").mapInArrow(found, BOUNDS)


def exact_scores(docs: DataFrame, candidates: DataFrame, items: Items, w: Weights, small: bool) -> DataFrame:
    """``item, doc_id, score`` above 0 of the candidates (``item, doc_id``), from their whole texts.

    ``small`` says that the candidates' ids have a proven or counted bound: then they go to the scan; else both sides are shuffled by id.
    """
    wanted = candidates.groupBy("doc_id").agg(F.collect_set("item").alias("wanted")).select(F.col("doc_id").alias("of_doc"), "wanted")
    rows = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")))
    hashes, terms, counts = items.hashes, items.terms, items.counts

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, wants = batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist()
            out: list[tuple] = []
            for s in slices(batch.column("text"), TERM_BYTES, lower=True):
                words = s.word_hashes()
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                here = hashes[at] == words
                for k in range(s.n):
                    a, b = s.word_at[k], s.word_at[k + 1]
                    if a == b:
                        continue
                    tf = np.bincount(at[a:b][here[a:b]], minlength=len(hashes))
                    parts = w.of_term * part_of(tf, w.lengths(np.int64(b - a)))
                    for item in wants[s.first + k]:
                        out.append((item, doc_ids[s.first + k], int((parts[terms[item]] * counts[item]).sum())))
            out = [x for x in out if x[2] > 0]
            yield pa.RecordBatch.from_pydict({"item": pa.array([x[0] for x in out], pa.int32()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    return rows.select("doc_id", "text", "wanted").mapInArrow(scored, "item int, doc_id bigint, score bigint")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _searched(docs: DataFrame, built: DataFrame, items: Items, top: int, probe: int) -> DataFrame:
    w = weights(built, items)
    bounds = cut(highest_bounds(built, items, w, probe))
    first = cut(_ranked(exact_scores(docs, bounds, items, w, small=True), top))  # at most ITEMS * probe ids
    # Of at most ITEMS items: the last of the best scores, and the lowest bound if there may be others below it.
    least = {r.item: r.score for r in first.where(F.col("rank") == top).select("item", "score").collect()}
    lowest = {r.item: r.bound for r in bounds.where(F.col("place") == probe).select("item", "bound").collect()}
    not_settled = {k: least.get(k, 1) for k, bound in lowest.items() if bound * (1 + 2.0**-40) >= least.get(k, 1)}
    if not_settled:
        rest = cut(reaching(built, items, w, not_settled))
        small = rest.count() <= BROADCAST_IDS
        second = _ranked(exact_scores(docs, rest, items, w, small), top)
        first = first.where(~F.col("item").isin(list(not_settled))).unionByName(second)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item int, item_id bigint")
    return first.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, probe: int = PROBE, built: DataFrame | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` documents; ``built`` is an index made before."""
    built = index(docs) if built is None else built
    found = [_searched(docs, built, block, top, max(top, probe)) for block in item_blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)

"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives both its minimum and its maximum, so ``permutations``
evaluations make a signature of twice that length. Bands of it put documents into buckets.

Exact copies (equal word sequences) are one node first. Then:
1. every node is paired with a pivot of each of its buckets (its least node in one of several orders);
   pairs whose set sizes allow a link are confirmed on the texts and united into classes;
2. nodes that share a bucket with a node of another class, neither of them its pivot, are open. Their links are found exactly: shingles are
   put in one order, those of few classes first, and only pairs that share a shingle among the first of
   both, as many as a link cannot do without, are confirmed. A group that drifts (copies of copies, alike but
   not linked) differs in such shingles, so it makes few pairs however many buckets it shares.
So every pair that shares a bucket is in one class or is known not to be a link. No step makes all
pairs of a bucket, and no bucket is gathered in a task.

Defined results: texts without words (null, empty, blank) have an empty set and link with nothing;
with fewer than ``words`` words the whole sequence is the one shingle; rows with a null id link with nothing and
have a null component, kept; repeated rows share their node, and different texts under one id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import cut
from ..plans.graph import components
from .words import free_name, in_small_batches, mixed, slices


#: Orders of ids, as values to combine with them bit by bit.
_ORDERS = [0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x369DEA0F31A53F85, 0x1B873593CC9E2D51]


@dataclass(frozen=True)
class Settings:
    """``bands`` times ``rows`` is twice the permutations. At similarity 0.75 a pair is missed with (1 - 0.75**rows)**bands = 0.0003."""

    words: int = 5
    percent: int = 75
    bands: int = 30
    rows: int = 5
    seed: int = 3
    #: Candidate ids up to which their set is broadcast to prune the second read of the texts (8 MB).
    broadcast_ids: int = 1_000_000

    @property
    def permutations(self) -> int:
        return -(-self.bands * self.rows // 2)


def shingles(s, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, sorted and distinct per text, and n + 1 offsets."""
    hashes = s.word_hashes()
    windows, at = s.windows(hashes, words)
    count = np.diff(s.word_at)
    short = np.flatnonzero((count > 0) & (count < words))
    parts: list[np.ndarray] = []
    whole = {}
    for k in short:  # fewer than ``words`` words: one shingle
        value = count[k : k + 1].astype(np.uint64)
        for w in range(s.word_at[k], s.word_at[k + 1]):
            value = mixed(value ^ hashes[w : w + 1]) + hashes[w : w + 1]
        whole[k] = value
    for k in range(s.n):
        parts.append(whole[k] if k in whole else np.unique(windows[at[k] : at[k + 1]]))
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _signer(c: Settings):
    random = np.random.default_rng(c.seed)
    odd = random.integers(0, 1 << 63, c.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = random.integers(0, 1 << 63, c.permutations, dtype=np.uint64)

    def signed(texts: pa.Array) -> pa.Array:
        """Set size, a digest of the word sequence, and one bucket key per band."""
        counts, digests, keys, valid = [], [], [np.zeros((0, c.bands), np.uint64)], []
        for s in slices(texts, lower=True):
            values, at = shingles(s, c.words)
            raw = s.data.tobytes()
            sizes = np.diff(at)
            counts.append(sizes)
            full = np.flatnonzero(sizes)
            signature = np.zeros((2 * c.permutations, s.n), np.uint64)
            if len(full):
                begins = at[:-1][full]
                for k in range(c.permutations):
                    x = values * odd[k] + add[k]
                    signature[2 * k, full] = np.minimum.reduceat(x, begins)
                    signature[2 * k + 1, full] = np.maximum.reduceat(x, begins)
            # Neighbours in a band come from different permutations, as far as that goes.
            order = np.concatenate([np.arange(0, 2 * c.permutations, 2), np.arange(1, 2 * c.permutations, 2)])[: c.bands * c.rows]
            key = np.broadcast_to(np.arange(c.bands, dtype=np.uint64)[:, None], (c.bands, s.n)).copy()
            for row in range(c.rows):
                key = mixed(key ^ signature[order[row :: c.rows]]) + np.uint64(row)
            keys.append(key.T)
            valid.append(sizes > 0)
            for k in range(s.n):
                words = raw[s.text_at[k] : s.text_at[k + 1]].split()
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
        every, has = np.concatenate(keys), np.concatenate(valid) if valid else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(np.where(has, c.bands, 0))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(every[has].ravel().view(np.int64)))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], ["n_shingles", "digest", "bands"])

    kind = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return F.arrow_udf(signed, kind).asNondeterministic()


def _confirmer(c: Settings):
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        """Whether the full sets of two texts are similar enough. Texts that recur in a batch are shingled once."""
        recent: OrderedDict[str, np.ndarray] = OrderedDict()

        def sets(texts: list[str]) -> list[np.ndarray]:
            new = [t for t in dict.fromkeys(texts) if t not in recent]
            for s in slices(pa.array(new, pa.large_string()), lower=True):
                values, at = shingles(s, c.words)
                for k in range(s.n):
                    recent[new[s.first + k]] = values[at[k] : at[k + 1]]
            found = [recent[t] for t in texts]
            while len(recent) > 256:
                recent.popitem(last=False)
            return found

        out = np.zeros(len(a), bool)
        for first in range(0, len(a), 64):
            left, right = sets(a.slice(first, 64).to_pylist()), sets(b.slice(first, 64).to_pylist())
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                least, most = sorted((len(x), len(y)))
                if 100 * least < c.percent * most or not least:
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                out[first + k] = 100 * both >= c.percent * (len(x) + len(y) - both)
        return pa.array(out)

    return F.arrow_udf(linked, T.BooleanType()).asNondeterministic()


def _sets(c: Settings):
    def distinct(texts: pa.Array) -> pa.Array:
        """The distinct shingle hashes of each text."""
        found = [shingles(s, c.words) for s in slices(texts, lower=True)]
        values = np.concatenate([np.zeros(0, np.uint64), *[v for v, _ in found]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(at) for _, at in found]])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))

    return F.arrow_udf(distinct, T.ArrayType(T.LongType())).asNondeterministic()


def _texts(ids: DataFrame, docs: DataFrame, c: Settings) -> DataFrame:
    """``doc_id`` and ``text`` of the documents in ``ids``."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    return texts.join(F.broadcast(ids) if ids.count() <= c.broadcast_ids else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, c: Settings) -> DataFrame:
    """The classes ``ca, cb`` of pairs whose texts are linked. Only the texts of candidates are shuffled."""
    texts = _texts(cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), docs, c)
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b")
    return cut(both.withColumn("linked", _confirmer(c)("text_a", "text_b")).where("linked").select("ca", "cb"))


def signatures(docs: DataFrame, c: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the word sequence and ``bands`` of each row."""
    return in_small_batches(docs).select("doc_id", _signer(c)(F.col("text")).alias("s")).select("doc_id", "s.*")


def _reduced(owner: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``x, n, class`` after confirmed pairs of classes (``ca``, ``cb``) are united."""
    found = components(confirmed, "ca", "cb").withColumnRenamed("node", "class")
    return cut(owner.join(found, "class", "left").select("x", "n", F.coalesce("component", "class").alias("class")))


def _alike(n: Column, m: Column, c: Settings) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(n, m) >= F.lit(c.percent) * F.greatest(n, m)


def _up(a: Column, b: int) -> Column:
    """``a / b``, rounded up."""
    return F.call_function("div", a + F.lit(b - 1), F.lit(b))


def classes(signed: DataFrame, docs: DataFrame, c: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Nodes (``digest``, ``node``), and the classes (``x``, ``class``) of those that share a bucket with another."""
    nodes = cut(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")))
    banded = signed.join(nodes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    rows = banded.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # Buckets take their pivots in a few different orders, so that a long drifting group has pivots all along.
    order = F.element_at(F.array(*[F.lit(o) for o in _ORDERS]), (F.pmod("bucket", F.lit(len(_ORDERS))) + 1).cast("int"))
    full = rows.groupBy("bucket").agg(F.min(F.struct(F.col("x").bitwiseXOR(order), "x", "n")).alias("p"), F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high")
    near = cut(rows.join(full.select("bucket", F.col("p.x").alias("pivot"), F.col("p.n").alias("pivot_n")), "bucket").distinct())
    owner = cut(near.groupBy("x").agg(F.max("n").alias("n")).withColumn("class", F.col("x")))

    possible = near.where(F.col("x") != F.col("pivot")).where(_alike(F.col("n"), F.col("pivot_n"), c)).select(F.least("x", "pivot").alias("a"), F.greatest("x", "pivot").alias("b")).distinct()
    owner = _reduced(owner, _confirmed(cut(possible.withColumns({"ca": F.col("a"), "cb": F.col("b")})), docs, c))

    others = near.where(F.col("x") != F.col("pivot")).select("bucket", "x").join(owner, "x")
    mixed_up = others.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("bucket")
    still_open = cut(others.join(mixed_up, "bucket").select("x", "class").distinct())
    owner = _reduced(owner, _confirmed(cut(_first_shared(still_open, docs, c)), docs, c))
    return nodes, owner


def _first_shared(nodes: DataFrame, docs: DataFrame, c: Settings) -> DataFrame:
    """All pairs of ``nodes`` (``x``, ``class``) of different classes that can be linked, and some that are not: ``a, b, ca, cb``.

    With n shingles in a set and p percent asked for, a link shares at least p% of the larger set, and at least
    2p / (100 + p) of the smaller one; so both share one of their first shingles in any order common to all. The
    order is by how many nodes have a shingle; those that only one class has come first and cannot be shared.
    """
    texts = _texts(nodes.select(F.col("x").alias("doc_id")), docs, c)
    sets = cut(in_small_batches(texts).select(F.col("doc_id").alias("x"), _sets(c)(F.col("text")).alias("set")).dropDuplicates(["x"]).join(nodes, "x"))
    every = sets.select("x", "class", F.size("set").cast("long").alias("n"), F.explode("set").alias("shingle"))
    known = every.groupBy("shingle").agg(F.count("*").alias("f"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shingle", "f")

    mine = Window.partitionBy("x")
    shared = every.join(known, "shingle").withColumn("n_shared", F.count("*").over(mine))
    shared = shared.where(F.lit(100) * F.col("n_shared") >= F.lit(c.percent) * F.col("n"))
    placed = shared.withColumn("at", F.col("n") - F.col("n_shared") + F.row_number().over(mine.orderBy("f", "shingle")))
    ahead = cut(placed.where(F.col("at") <= F.col("n") - _up(F.col("n") * c.percent, 100) + 1).select("x", "class", "n", "shingle", "at"))

    # Rows of a shingle's largest class are never compared with each other.
    by_class = ahead.groupBy("shingle", "class").agg(F.count("*").alias("rows"))
    largest = by_class.groupBy("shingle").agg(F.max_by("class", F.struct("rows", "class")).alias("largest"), F.count("*").alias("k")).where("k > 1").select("shingle", "largest")
    held = ahead.join(largest, "shingle").withColumn("main", F.col("class") == F.col("largest"))
    asking = held.select("shingle", F.col("main").cast("int").alias("side"), F.struct("x", "class", "n", "at").alias("l"))
    asked = held.where(F.col("at") <= F.col("n") - _up(F.col("n") * 2 * c.percent, 100 + c.percent) + 1)
    asked = asked.select("shingle", F.explode(F.when(F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"), F.struct("x", "class", "n", "at").alias("r"))

    smaller = (F.col("r.n") < F.col("l.n")) | ((F.col("r.n") == F.col("l.n")) & (F.col("r.x") < F.col("l.x")))
    least = _up((F.col("l.n") + F.col("r.n")) * c.percent, 100 + c.percent)  # a link shares so many
    most = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) + 1  # of the first that they share and all that follow
    joined = asking.join(asked, ["shingle", "side"]).where((F.col("l.class") != F.col("r.class")) & smaller & _alike(F.col("l.n"), F.col("r.n"), c) & (most >= least))
    first = F.col("l.x") < F.col("r.x")
    return joined.select(
        F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b"),
        F.when(first, F.col("l.class")).otherwise(F.col("r.class")).alias("ca"), F.when(first, F.col("r.class")).otherwise(F.col("l.class")).alias("cb"),
    ).distinct()


def dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``."""
    signed = cut(signatures(docs, settings))
    nodes, found = classes(signed, docs, settings)
    named = nodes.join(found.select(F.col("x").alias("node"), "class"), "node", "left").select(F.col("digest").alias("key"), F.coalesce("class", "node").alias("component_id"))
    # Texts without words are dealt by their ids.
    joined = signed.withColumn("key", F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))).join(named, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = joined.select("doc_id", "n_shingles", own.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, with the columns of ``docs`` and no others.

    Of rows that share an id only the first by content stays; rows without an id all stay.
    """
    kept = dedup(docs, settings).where("kept and doc_id is not null").select("doc_id").distinct()
    columns, number = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, "_number")
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*columns))))
    return chosen.where(f"{number} = 1").select(*columns).unionByName(docs.where("doc_id is null"))

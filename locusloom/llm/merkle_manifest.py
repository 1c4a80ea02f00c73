"""A Merkle manifest of a document table, kept in van Emde Boas layout.

Every row is a leaf; the leaves of a language, in order of id, are the bottom of a tree in which each run of ``FANOUT`` nodes (the last run: fewer,
even one) has one parent, until one node is left. The languages' roots are the leaves of one more such tree.

Trees are stored as aligned subtrees of ``HEIGHT`` levels above their leaves. A subtree's nodes are one byte string in van Emde Boas order: the
tree is split at half its height, the top part comes first, then each bottom part, every part laid out in the same way. ``addresses``
gives the place of the node with an index on a level, for building and for fetching siblings. The roots of the subtrees are the leaves
of the next tier of subtrees, until a tree has one subtree; so the driver counts tiers, and no task holds more than a subtree.

Proofs go the other way: each subtree gets the siblings on its root's way up, one row per subtree, and adds its own.

Defined results: each row is a leaf, so repeated rows are leaves of their own (ties in id by leaf digest); a null id comes first in its
language and is never tampered with; a null language is a tree like any other and the first; null and empty texts differ, as nulls are ``-``;
a language of one row is its own subroot; an empty table gives an empty result; only the named columns are read; texts of any length are hashed
where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals

#: Children of a node, as a power of two; levels of a stored subtree above its leaves.
BITS, HEIGHT = 3, 4
FANOUT, SPAN = 1 << BITS, 1 << (BITS * HEIGHT)

#: The columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tree_size(levels: int) -> int:
    """Nodes of a complete tree."""
    return ((1 << (BITS * levels)) - 1) // (FANOUT - 1)


def _address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes with an index at a depth (0: the root) of a complete tree."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return _address(top, depth, index)
    below = BITS * (depth - top)
    bottom = levels - top
    return tree_size(top) + (index >> below) * tree_size(bottom) + _address(bottom, depth - top, index & ((1 << below) - 1))


@lru_cache(maxsize=16)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each level from the leaves up, where its nodes lie in the layout."""
    return tuple(_address(levels, depth, np.arange(1 << (BITS * depth))) for depth in range(levels - 1, -1, -1))


def levels_of(n: int) -> int:
    """Levels of the lowest tree over ``n`` leaves."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Subtree:
    """A subtree in its layout: ``n`` leaves, ``levels`` levels, 32 bytes a node; nodes that do not exist are zero."""

    def __init__(self, nodes: np.ndarray, n: int, levels: int) -> None:
        self.nodes, self.n, self.levels = nodes, n, levels
        self.at = addresses(levels)

    @staticmethod
    def built(leaves: np.ndarray, levels: int) -> Subtree:
        """The subtree over digests, as rows of 32 bytes."""
        out = Subtree(np.zeros((tree_size(levels), 32), np.uint8), len(leaves), levels)
        out.nodes[out.at[0][: len(leaves)]] = leaves
        for level in range(1, levels):
            below = out.digests(level - 1)
            wide = 64 * FANOUT
            made = b"".join([sha256(below[k : k + wide]).digest() for k in range(0, len(below), wide)])
            out.nodes[out.at[level][: len(made) // 32]] = np.frombuffer(made, np.uint8).reshape(-1, 32)
        return out

    def count(self, level: int) -> int:
        return -(-self.n // (1 << (BITS * level)))

    def digests(self, level: int) -> bytes:
        """The level's digests as hex text, from left to right."""
        return self.nodes[self.at[level][: self.count(level)]].tobytes().hex().encode()

    def root(self) -> bytes:
        return self.nodes[self.at[-1][0]].tobytes()

    def siblings(self) -> list[list[tuple[bytes, bytes]]]:
        """Per level below the root and node: the digests left and right of it in its run."""
        out = []
        for level in range(self.levels - 1):
            text, found = self.digests(level), []
            for k in range(self.count(level)):
                first = k - k % FANOUT
                found.append((text[64 * first : 64 * k], text[64 * (k + 1) : 64 * (first + FANOUT)]))
            out.append(found)
        return out


def leaf(text: Column) -> Column:
    """A row's digest, with ``text`` as its text."""
    parts = []
    for name in FIELDS:
        value = (text if name == "text" else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, tampered``: digests of the rows as they are, and of those that are tampered with (else null).

    ``tree`` names the language so that null sorts first: empty for null, else ``=`` and the language. Texts go no further than this.
    """
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    folded = F.translate("text", _UPPER, _LOWER)
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(folded)).alias("tampered"))


SUBTREES = "tree string, block bigint, n int, levels int, root binary, nodes binary, doc_ids array<bigint>, tampered array<binary>"
_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary()))])


def subtrees(placed: DataFrame) -> DataFrame:
    """Stored subtrees over ``tree, place, digest`` (and, for leaves of rows, ``doc_id`` and ``tampered``)."""
    rows = placed.withColumn("block", F.floor(F.col("place") / SPAN).cast("bigint"))

    def built(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree, block, n = key[0].as_py(), key[1].as_py(), len(table)
        levels = HEIGHT + 1 if block or n == SPAN else levels_of(n)
        digests = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        made = Subtree.built(digests, levels)
        carried = {name: table[name].to_pylist() if name in table.column_names else None for name in ("doc_ids", "tampered")}
        return pa.Table.from_pylist([{"tree": tree, "block": block, "n": n, "levels": levels, "root": made.root(), "nodes": made.nodes.tobytes(), **carried}], schema=_ARROW)

    return cut(rows.groupBy("tree", "block").applyInArrow(built, SUBTREES))


def roots(stored: DataFrame) -> DataFrame:
    """The roots of subtrees, placed as leaves of the tier above."""
    return stored.select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))


def tiers(placed: DataFrame) -> list[DataFrame]:
    """Tiers of subtrees from the leaves up; in the last each tree has one."""
    out = [subtrees(placed)]
    while not out[-1].where("block > 0").isEmpty():
        out.append(subtrees(roots(out[-1])))
    return out


@dataclass(frozen=True)
class Manifest:
    """The stored tiers over rows, those over languages, and ``tree, place, digest`` of the languages' roots."""

    rows: list[DataFrame]
    languages: list[DataFrame]
    subroots: DataFrame


def manifest(docs: DataFrame) -> Manifest:
    """Build the manifest of ``docs``. Rows are numbered over range partitions, so a language of any size is many tasks."""
    stored = cut(leaves(docs))  # texts are hashed once, also where rows are sampled for ranges
    numbered = prefix_totals(stored.withColumn("tie", F.monotonically_increasing_id()), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")], rows="place")
    rows = tiers(numbered.select("tree", "place", F.col("leaf").alias("digest"), F.col("doc_id").alias("doc_ids"), "tampered"))
    subroots = cut(prefix_totals(rows[-1].select("tree", F.col("root").alias("digest")), [], ["tree"], rows="place"))
    return Manifest(rows, tiers(subroots.select(F.lit("").alias("tree"), "place", "digest")), subroots)


PATHS = "tree string, place bigint, before array<binary>, after array<binary>, subroot string"


def _subtree(row: dict) -> Subtree:
    return Subtree(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["n"], row["levels"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _path(siblings: list[list[tuple[bytes, bytes]]], k: int) -> list[tuple[bytes, bytes]]:
    return [level[k >> (BITS * h)] for h, level in enumerate(siblings)]


def paths(stored: DataFrame, above: DataFrame | None) -> DataFrame:
    """``tree, place, before, after``: for every leaf of a tier, the siblings on its way to the tree's root, level by level.

    ``subroot`` is handed down. ``above`` has the same for the tier's subtrees (by ``place``); none for the last tier of a tree that stands alone.
    """
    if above is None:
        none = F.array().cast("array<binary>")
        joined = stored.select("*", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"))
    else:
        joined = stored.join(above.withColumnRenamed("place", "block"), ["tree", "block"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            siblings = _subtree(row).siblings()
            found = [_path(siblings, k) for k in range(row["n"])]
            for first in range(0, row["n"], 512):
                some = found[first : first + 512]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([row["tree"]] * len(some), pa.string()),
                    "place": pa.array(row["block"] * SPAN + first + np.arange(len(some)), pa.int64()),
                    "before": pa.array([[*[x for x, _ in p], *row["before"]] for p in some], pa.list_(pa.binary())),
                    "after": pa.array([[*[x for _, x in p], *row["after"]] for p in some], pa.list_(pa.binary())),
                    "subroot": pa.array([row["subroot"]] * len(some), pa.string()),
                })

    return joined.select("tree", "block", "n", "levels", "nodes", "before", "after", "subroot").mapInArrow(walked, PATHS)


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a digest leads to."""
    for before, after in path:
        digest = sha256(before + digest.encode() + after).hexdigest()
    return digest


def proofs(built: Manifest) -> DataFrame:
    """Each row's leaf, its subroot, the root, the digest of its siblings, and what the row, or its tampered form, folds up to."""
    top = built.languages[-1].first()
    if top is None:
        return built.subroots.sparkSession.createDataFrame([], PROOFS)
    root = top.root.hex()
    above = None
    for tier in reversed(built.languages):
        above = paths(tier, above)
    named = built.subroots.select(F.col("tree").alias("language"), F.lower(F.hex("digest")).alias("of_language"), "place").join(above, "place")
    above = cut(named.select(F.col("language").alias("tree"), F.lit(0).cast("bigint").alias("place"), "before", "after", F.col("of_language").alias("subroot")))
    for tier in reversed(built.rows[1:]):
        above = paths(tier, above)
    bottom = built.rows[0].join(above.withColumnRenamed("place", "block"), ["tree", "block"])

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tree, n = _subtree(row), row["n"]
            siblings, text = tree.siblings(), tree.digests(0).decode()
            rest = list(zip(row["before"], row["after"], strict=True))
            tail = b"".join(x for pair in rest for x in pair)
            own = [text[64 * k : 64 * (k + 1)] for k in range(n)]
            proof, folded = [], []
            for k, (digest, other) in enumerate(zip(own, row["tampered"], strict=True)):
                path = _path(siblings, k)
                proof.append(sha256(b"".join([x for pair in path for x in pair]) + tail).hexdigest())
                folded.append(fold(fold(other.hex() if other is not None else digest, path), rest))
            out = [row["doc_ids"], own, [row["subroot"]] * n, [root] * n, proof, folded, [x == root for x in folded]]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=[f.split()[0] for f in PROOFS.split(", ")])

    return bottom.select("n", "levels", "nodes", "doc_ids", "tampered", "before", "after", "subroot").mapInArrow(proved, PROOFS)

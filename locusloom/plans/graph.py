"""Connected components as rounds of joins; nothing of the graph reaches the driver but its edge count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut

#: Rows that a stored partition of a shrinking graph holds at least, so that small rounds are few tasks.
_ROWS = 20_000

#: Salts that reorder the ids from round to round, so that long sorted chains shrink by a constant share.
_SALTS = [0, 0x5BD1E9955BD1E995, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x1B873593CC9E2D51, 0x0F4A7C15F39CC060]

#: Rounds after which the table of roots is stored.
_STORED = 4

#: Edges up to which what is left of a graph is united in one task (1.6 MB): a bound that holds for graphs of any size, so rounds go on until then.
FEW = 100_000


def _few_united(edge: DataFrame) -> DataFrame:
    """``node, to``: the least node of its component for each other node of at most ``FEW`` edges ``a, b``, in one task."""
    kind = edge.schema["a"].dataType.simpleString()

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By columns: whether an end may be null is part of a batch's schema.
        ends = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*ends, strict=True) if ends else ((), ())))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        to = nodes[least_labels(place[: len(a)], place[len(a) :], len(nodes))]
        yield pa.RecordBatch.from_pydict({"node": nodes[to != nodes], "to": to[to != nodes]})

    found = edge.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInArrow(united, "node bigint, to bigint")
    return found.select(F.col("node").cast(kind).alias("node"), F.col("to").cast(kind).alias("to"))


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node id.

    Each round every node points to the least of itself and its neighbours (in a salted order of
    ids) and the edges are rewritten to what their ends point to; loops and repeats go. Stars
    around their smallest node vanish in the first round. Null ends are ignored. Once ``few`` edges are left, no more rounds are planned for them.
    """
    edge = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and a <> b").distinct()
    first = edge = cut(edge)
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pointers: list[DataFrame] = []
    while (n := edge.count()) > few:
        parts, turn = min(most, 8 + n // _ROWS), len(pointers)
        salt = F.lit(_SALTS[turn % len(_SALTS)] ^ (turn // len(_SALTS)))
        both = edge.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edge.select(F.col("b").alias("node"), F.col("a").alias("near")))
        near = F.min(F.col("near").bitwiseXOR(salt))
        to = both.groupBy("node").agg(F.least(near, F.col("node").bitwiseXOR(salt)).bitwiseXOR(salt).alias("to")).where("to <> node")
        to = cut(to.coalesce(parts))
        pointers.append(to)
        at_a = to.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        at_b = to.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        moved = edge.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        edge = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(parts))

    if n and not pointers:
        to = cut(_few_united(edge))
        return to.select("node", F.col("to").alias("component")).unionByName(to.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
    if n:
        pointers.append(cut(_few_united(edge)))

    # One table of roots, moved on once for each round; stored now and then, so that the plan stays short.
    roots = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for turn, to in enumerate(pointers):
        later = to.select(F.col("node").alias("root"), F.col("to").alias("later"))
        roots = roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
        if turn % _STORED == _STORED - 1:
            roots = cut(roots)
    roots = cut(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return cut(roots.join(least, "root").select("node", "component"))


def least_labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node of its component for each of ``n`` nodes; ``x`` and ``y`` are the ends of the edges."""
    label = np.arange(n)
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_edges = low != high
        x, y, low, high = x[open_edges], y[open_edges], low[open_edges], high[open_edges]
        np.minimum.at(label, high, low)
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


def components_within(rows: DataFrame, key: str, node: str, link: str, into: str) -> DataFrame:
    """One row per ``node`` of ``rows``, without ``link``, and with the least node that shared values of ``link`` lead to; null for a node alone.

    A node has one key, and values of ``link`` are compared inside a key. A key's rows meet in one task, so keys are to be counted small
    before. A node's other columns are the same in all of its rows; nulls of ``link`` lead nowhere.
    """
    others = [c for c in rows.columns if c != link]

    def united(table: pa.Table) -> pa.Table:
        nodes, first, place = np.unique(table[node].to_numpy(), return_index=True, return_inverse=True)
        linked = table[link].is_valid().to_numpy()
        value, at = pc.drop_null(table[link]).to_numpy(), place[linked]
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        label = least_labels(at[order][:-1][same], at[order][1:][same], len(nodes))
        alone = np.bincount(label, minlength=len(nodes))[label] == 1
        return table.select(others).take(pa.array(first)).append_column(into, pa.array(nodes[label], pa.int64(), mask=alone))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(key).applyInArrow(united, ", ".join([*[f"`{c}` {kinds[c]}" for c in others], f"`{into}` bigint"]))


def greedy_pairs(rows: DataFrame, keys: Sequence[str], left: str, right: str, order: str) -> DataFrame:
    """Rows taken one by one in ``order`` (unique in a key), each ``left`` and each ``right`` value of a key used once.

    A row that is first for both its ends is taken whatever the others are, so all such rows are taken at once, those that
    share an end with them go, and the rest is looked at again. Rows in random order need about as many turns as
    the logarithm of their number. Rows with a null key or end are never taken.
    """
    open_rows = cut(rows.dropna(subset=[*keys, left, right]))
    taken = []
    while not open_rows.isEmpty():
        first = lambda end: open_rows.groupBy(*keys, end).agg(F.min(order).alias(order))  # noqa: E731, B023
        now = cut(open_rows.join(first(left), [*keys, left, order], "left_semi").join(first(right), [*keys, right, order], "left_semi"))
        taken.append(now)
        open_rows = cut(open_rows.join(now.select(*keys, left), [*keys, left], "left_anti").join(now.select(*keys, right), [*keys, right], "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else rows.limit(0)

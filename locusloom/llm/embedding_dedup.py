"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are first made one node with a weight. In each pass a node gets a code of
concatenated random-hyperplane bits; nodes are ordered by (label, code), and each is compared with
the next ``window`` nodes of that order. The order of all passes is one range-partitioned sort of
narrow rows, cut into equal blocks that overlap by one window, so no label, code or group of copies
makes a task larger. Verified pairs of all passes are united into components (a block sends a
spanning forest, never all pairs). Links lie inside components, so an exact count follows there, in
tiles of bounded size: a dense group keeps every link, however far it outgrows the window.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label or id, link with nothing (0 links, own component, kept); equal rows link with each other; different
vectors under one id are one node; vectors of different lengths never link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import cut
from ..plans.graph import components
from ..plans.ordering import prefix_totals


@dataclass(frozen=True)
class Settings:
    """``recall`` is that of one lone pair at exactly ``cosine``; it sets the number of passes, at least that of evenly spread vectors."""

    cosine: float = 0.93
    window: int = 48
    block: int = 512
    tile: int = 1024
    salts: int = 16
    recall: float = 0.9995
    least_passes: int = 6
    seed: int = 11

    def passes(self, n: int) -> int:
        """Passes so that a pair shares a window in one of them with probability ``recall``, for ``n`` evenly spread nodes in a label."""
        bits = max(0.0, math.log2(max(n, 1) / (self.window / 2)))
        once = (1 - math.acos(self.cosine) / math.pi) ** bits
        return max(self.least_passes, math.ceil(math.log(1 - self.recall) / math.log(1 - min(once, 0.999))))


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coder(first: int, passes: int, seed: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def codes(vectors: pa.Array) -> pa.Array:
        """One 63-bit code per pass; vectors of one length share their hyperplanes."""
        out = np.zeros((len(vectors), passes - first), np.int64)
        sizes = np.asarray(vectors.value_lengths())
        flat, at = np.asarray(vectors.flatten(), dtype=np.float64), np.concatenate([[0], np.cumsum(sizes)])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = flat[at[rows][:, None] + np.arange(size)]
            for k in range(first, passes):
                planes = np.random.default_rng([seed, int(size), k]).normal(size=(size, 63))
                out[rows, k - first] = ((x @ planes) > 0) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * (passes - first), pa.int32()), pa.array(out.ravel()))

    return codes


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the first place that its component has."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors per label: ``label``, ``v``, ``node`` (least id) and ``weight``."""
    v = F.col("v")
    usable = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    return usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))


def _bits(code: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For rows in order: the shortest prefix whose nodes all fit a window, so that a pair which shares it meets; -1 where the order is cut off."""
    out, ahead = np.full(len(code), -1), window + 1
    if len(code) > 2 * ahead:
        differ = code[:-ahead] ^ code[ahead:]
        shared = np.array([63 - int(x).bit_length() for x in differ])
        shared[group[:-ahead] != group[ahead:]] = -1
        out[ahead:-ahead] = 1 + np.lib.stride_tricks.sliding_window_view(shared, ahead + 1).max(axis=1)
    return out


def needed_passes(compared: DataFrame, s: Settings) -> int:
    """Passes that reach ``recall`` in every label, from the prefixes measured at all nodes.

    A lone pair at ``cosine`` shares b bits with probability p^b, whatever the other vectors are like. Nodes whose links
    were found do not count as missed.
    """
    p = 1 - math.acos(s.cosine) / math.pi
    measured = compared.where("bits is not null").groupBy("label", "a").agg(F.avg(F.pow(F.lit(p), F.col("bits"))).alias("once"), F.max("linked").alias("linked"))
    # The least of p^b is p^63, so the last of these always suffices.
    grid = [math.ceil(s.least_passes * 1.1**k) for k in range(150) if s.least_passes * 1.1**k < 2 * -math.log(1 - s.recall) / p**63]
    missed = measured.groupBy("label").agg(*[F.avg(F.when(F.col("linked"), 0.0).otherwise(F.pow(1 - F.col("once"), F.lit(n)))).alias(f"_{k}") for k, n in enumerate(grid)])
    worst = missed.agg(*[F.max(f"_{k}") for k in range(len(grid))]).first()
    return next((n for n, share in zip(grid, worst, strict=True) if (share or 0.0) <= 1 - s.recall), grid[-1])


def near_pairs(nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes that are linked, enough to connect all that the passes find."""
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = s.passes(largest)
    compared = cut(_compared(nodes, s, 0, passes))
    needed = needed_passes(compared, s)
    if needed > passes:
        compared = compared.unionByName(_compared(nodes, s, passes, needed))
    return compared.where("bits is null").select("a", "b")


def _compared(nodes: DataFrame, s: Settings, first: int, passes: int) -> DataFrame:
    """Of passes from ``first`` on: pairs ``a``, ``b``; in the passes from 0 also ``a, label, bits, linked`` of each node and pass."""
    coded = nodes.select("label", "node", F.posexplode(_coder(first, passes, s.seed)("v")).alias("turn", "code"))
    ordered = prefix_totals(coded, [], ["turn", "label", "code", "node"], rows="place").select("turn", "label", "node", "code", "place")
    block = F.floor(F.col("place") / s.block)
    late = F.col("place") % s.block >= s.block - s.window
    blocks = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = ordered.select("turn", "label", "node", "code", "place", F.explode(blocks).alias("block"))
    carried = dealt.join(nodes.select("node", "label", "v"), ["node", "label"])

    kinds = {"a": "Int64", "b": "Int64", "label": "Int64", "bits": "Int64", "linked": "boolean"}

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        ids, sizes = rows["node"].to_numpy(), rows["v"].map(len).to_numpy()
        group = rows["turn"].to_numpy() * np.int64(1 << 34) + rows["label"].to_numpy()
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = units([rows["v"].iloc[k] for k in at])
            place = rows["place"].to_numpy()[at]
            linked = np.triu(x @ x.T >= s.cosine, 1)
            linked &= group[at][:, None] == group[at][None, :]
            linked &= np.abs(place[:, None] - place[None, :]) <= s.window
            i, j = np.nonzero(linked)
            pairs.append((at[i], at[j]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        root = _forest(len(ids), a, b)
        joined = root != np.arange(len(ids))
        found = pd.DataFrame({"a": ids[root[joined]], "b": ids[joined]}, dtype="Int64").assign(label=pd.NA, bits=pd.NA, linked=pd.NA)
        if first:
            return found.astype(kinds)
        bits, linked = _bits(rows["code"].to_numpy(), group, s.window), np.zeros(len(ids), bool)
        linked[a] = linked[b] = True
        known = bits >= 0
        return pd.concat([found, pd.DataFrame({"a": ids[known], "b": pd.NA, "label": rows["label"].to_numpy()[known], "bits": bits[known], "linked": linked[known]})]).astype(kinds)

    return carried.groupBy("block").applyInPandas(compare, "a bigint, b bigint, label bigint, bits int, linked boolean")


def counted_links(grouped: DataFrame, s: Settings) -> DataFrame:
    """``node`` and ``label`` with ``near``: linked vectors of other nodes, counted exactly inside each component.

    A component of n nodes is compared in tiles of ``tile`` by ``tile``, each a task's group of its own.
    """
    sizes = grouped.groupBy("component", "label").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / s.tile))
    # A large component's rows are dealt by salt, and its size stands once for each salt.
    salts = F.sequence(F.lit(0), F.lit(s.salts - 1))
    salted = grouped.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(s.salts)).cast("int"))
    dealt = salted.join(sizes.withColumn("salt", F.explode(salts)), ["component", "label", "salt"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("row"), F.greatest(k, F.col("mine")).alias("column")))
    tiled = dealt.select("component", "label", "node", "weight", "v", "mine", F.explode(tiles).alias("tile"))
    # Dealt by tile: the join above leaves a component's rows together, and its tiles are to be many tasks.
    tiled = tiled.select("component", "label", "node", "weight", "v", "mine", F.col("tile.row").alias("tile_row"), F.col("tile.column").alias("tile_column")).repartition("component", "label", "tile_row", "tile_column")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        row, column = rows["tile_row"].iloc[0], rows["tile_column"].iloc[0]
        near = np.zeros(len(rows), np.int64)
        sizes, mine, weight = rows["v"].map(len).to_numpy(), rows["mine"].to_numpy(), rows["weight"].to_numpy()
        for size in np.unique(sizes):
            left, right = np.flatnonzero((sizes == size) & (mine == row)), np.flatnonzero((sizes == size) & (mine == column))
            if len(left) and len(right):
                linked = units([rows["v"].iloc[k] for k in left]) @ units([rows["v"].iloc[k] for k in right]).T >= s.cosine
                if row == column:
                    np.fill_diagonal(linked, False)
                    near[left] += linked @ weight[right]
                else:
                    near[left] += linked @ weight[right]
                    near[right] += linked.T @ weight[left]
        return pd.DataFrame({"node": rows["node"], "label": rows["label"], "near": near})

    counted = tiled.groupBy("component", "label", "tile_row", "tile_column").applyInPandas(count, T.StructType([T.StructField("node", T.LongType()), T.StructField("label", grouped.schema["label"].dataType), T.StructField("near", T.LongType())]))
    return counted.groupBy("node", "label").agg(F.sum("near").alias("near"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with labels of any type replaced by their places in order; null stays. A label stands once on the small side of the join."""
    places = cut(prefix_totals(rows.where("label is not null").select("label").distinct(), [], ["label"], rows="number"))
    return rows.join(places, "label", "left").select("vec_id", F.col("number").alias("label"), "v")


def dedup(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``embeddings``; labels may have any type that can be ordered."""
    rows = numbered(embeddings.select("vec_id", "label", F.col("embedding").alias("v")))
    nodes = cut(nodes_of(rows))
    labelled = components(near_pairs(nodes, settings)).withColumnRenamed("component", "found")
    grouped = cut(nodes.join(labelled, "node", "left").withColumn("component", F.coalesce("found", "node")).drop("found"))
    counts = counted_links(grouped, settings)
    known = grouped.join(counts, ["node", "label"], "left").select("label", "v", "component", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("links"))
    # Rows that have no node are dealt by their ids.
    alone = F.when(F.col("label").isNull() | F.col("v").isNull(), F.coalesce("vec_id", F.lit(0))).otherwise(F.lit(0)).cast("long")
    joined = rows.withColumn("alone", alone).join(known.withColumn("alone", F.lit(0).cast("long")), ["label", "v", "alone"], "left")
    result = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

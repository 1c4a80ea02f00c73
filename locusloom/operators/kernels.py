"""Scores from a given kernel model: a table of support vectors, their weights, and how features are scaled.

Kernel values are matrix products of Arrow batches with blocks of support vectors. A model of at most ``BLOCK`` support vectors
goes to every task; a larger one is taken block by block, each block one pass over the rows, and the passes' sums are added.

Defined results: null features, null or non-finite entries, or a wrong number of them give a null score and no points; a model without support
vectors gives its intercept; repeated rows are scored each, if ``row_id`` is unique or the model is one block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Support vectors that are sent to the tasks at once.
BLOCK = 4096


@dataclass(frozen=True)
class Kernel:
    """``exp(-gamma * distance squared)`` over features less ``mean``, divided by ``scale``; a row above 0 gets ``points``."""

    gamma: float
    intercept: float
    mean: Sequence[float]
    scale: Sequence[float]
    points: int = 10


def _blocks(support: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[float, list[float]]] = []
    for weight, vector in support.select("weight", "vector").toLocalIterator():
        held.append((weight, vector))
        if len(held) == block:
            yield np.array([w for w, _ in held]), np.array([v for _, v in held], np.float64)
            held = []
    if held:
        yield np.array([w for w, _ in held]), np.array([v for _, v in held], np.float64)


def kernel_scores(rows: DataFrame, support: DataFrame, kernel: Kernel, block: int = BLOCK) -> DataFrame:
    """``row_id, score, points`` of ``rows`` (``row_id``, ``features``); ``support`` has ``weight`` and ``vector``, in scaled features."""
    mean, scale = np.array(kernel.mean, np.float64), np.array(kernel.scale, np.float64)
    scale = np.where(scale == 0, 1.0, scale)

    def scored(weights: np.ndarray, vectors: np.ndarray) -> DataFrame:
        lengths = (vectors**2).sum(axis=1)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 512):
                    part = batch.slice(first, 512)
                    given = part.column("features").to_pylist()
                    fits = np.array([f is not None and len(f) == len(mean) and None not in f for f in given], bool)
                    x = np.array([f if ok else [0.0] * len(mean) for f, ok in zip(given, fits, strict=True)], np.float64).reshape(len(given), len(mean))
                    fits &= np.isfinite(x).all(axis=1)
                    x = (np.where(fits[:, None], x, 0.0) - mean) / scale
                    apart = np.maximum((x**2).sum(axis=1)[:, None] + lengths - 2 * x @ vectors.T, 0.0)
                    score = np.exp(-kernel.gamma * apart) @ weights
                    yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(score, pa.float64(), mask=~fits)], names=["row_id", "part"])

        return rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(of, "row_id bigint, part double")

    none = (np.zeros(0), np.zeros((0, len(mean))))
    parts = [scored(*b) for b in _blocks(support, block)] or [scored(*none)]
    total = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(F.sum("part").alias("part"))
    score = F.col("part") + F.lit(float(kernel.intercept))
    return total.select("row_id", score.alias("score"), F.when(score > 0, kernel.points).otherwise(0).alias("points"))

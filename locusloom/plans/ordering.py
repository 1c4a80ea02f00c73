"""Prefix totals in a global order, without putting a key's rows into one task.

A plain ``sum(...) over (partition by key order by ...)`` gathers each key in one task. Here the
rows are range-partitioned on (key, order), so a key of any size is spread over neighbouring
partitions; totals of the earlier partitions are added to a window inside each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

ROWS = "_rows_before"

#: Rows of one key that a window may take in one task.
SMALL = 100_000


def small_keys(df: DataFrame, keys: Sequence[str], most: int | None = None) -> bool:
    """Whether no key of stored rows has more than ``most`` of them (default ``SMALL``), counted before a window is put over keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"))
    return (counts.first()[0] or 0) <= (SMALL if most is None else most)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], measures: Mapping[str, tuple[str, Callable[[Column], Column]]], dealt: bool = False, keep: bool = False) -> DataFrame:
    """Add to each row an aggregate over the rows before it in its key; null for a key's first row.

    ``keep`` leaves the rows' partition in ``_part``; with it a further call in the same order (``dealt``) needs no new range shuffle.

    ``keys`` name columns without nulls (none: one global order), ``order`` columns or sort
    expressions; ``measures`` maps a new column to a column and an aggregate that
    can be taken again over its own results (sum, max, min).
    """
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not dealt:
        df = cut(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))

    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns({name: how(F.col(c)).over(inside) for name, (c, how) in measures.items()})

    totals = df.groupBy(*keys, "_part").agg(*[how(F.col(c)).alias(f"_t_{name}") for name, (c, how) in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *[how(F.col(f"_t_{name}")).over(earlier).alias(f"_b_{name}") for name, (_, how) in measures.items()])
    joined = placed.join(before, [*keys, "_part"])
    for name, (_, how) in measures.items():
        here, there = F.col(name), F.col(f"_b_{name}")
        both = here + there if how is F.sum else F.greatest(here, there) if how is F.max else F.least(here, there)
        joined = joined.withColumn(name, F.coalesce(both, here, there))
    return joined.drop(*([] if keep else ["_part"]), *[f"_b_{name}" for name in measures])


def prefix_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str] | None = None, rows: str | None = ROWS) -> DataFrame:
    """Add to each row totals of the rows before it in its key: ``sums`` maps new columns to columns, ``rows`` names the row count.

    Rows that tie in keys and order get consecutive places in some order.
    """
    measures = {name: (c, F.sum) for name, c in (sums or {}).items()} | ({rows: ("_one", F.sum)} if rows else {})
    found = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, measures).drop("_one")
    return found.withColumns({name: F.coalesce(name, F.lit(0)) for name in measures})


def with_adjacent(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add the structs ``before`` and ``after``: the columns of the rows next to each one in its key's order; null at the ends.

    Where a key has many rows, places are counted over range partitions and rows meet their neighbours by place, so no key is one task's
    work; where all keys are counted small, a window looks next to each row.
    """
    df = cut(df)
    if small_keys(df, keys):
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
        return df.withColumns({"before": F.lag(F.struct(*columns)).over(w), "after": F.lead(F.struct(*columns)).over(w)})
    placed = cut(prefix_totals(df, keys, order, rows="_place"))
    near = lambda step, name: placed.select(*keys, (F.col("_place") + step).alias("_place"), F.struct(*columns).alias(name))
    return placed.join(near(1, "before"), [*keys, "_place"], "left").join(near(-1, "after"), [*keys, "_place"], "left").drop("_place")

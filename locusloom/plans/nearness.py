"""Counts of the rows near each row, from prefix sums instead of pairs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .intervals import near_join
from .ordering import running

GENE = ["record_id", "gene_id"]


def near_counts(rows: DataFrame, facts: Mapping[str, tuple[str, int]], lengths: DataFrame | None = None) -> DataFrame:
    """``record_id, gene_id`` and for each fact (name to a 0/1 column of ``rows`` and a cutoff) how many other rows have it less than the cutoff away.

    ``rows`` have ``record_id, gene_id`` (unique together), ``start`` and ``end``. On linear records the number is that of starts before the row's
    end plus the cutoff, less that of ends up to its start less the cutoff. Both are prefix sums over range partitions, so rows
    that crowd make no pairs and no arrays. On circular records (``lengths``: ``record_id, length, circular``) an arc may be near on both sides,
    so there pairs are joined and summed before they are shuffled.
    """
    if lengths is None:
        return _on_lines(rows, facts)
    circles = lengths.where("circular").select("record_id", "length", "circular")
    marked = cut(rows.join(circles.select("record_id", F.lit(True).alias("_circle")), "record_id", "left"))
    return _on_lines(marked.where("_circle is null"), facts).unionByName(_on_circles(marked.where("_circle"), facts, circles))


def _on_lines(rows: DataFrame, facts: Mapping[str, tuple[str, int]]) -> DataFrame:
    flags = sorted({flag for flag, _ in facts.values()})
    point = lambda series, at, turn, reach: F.struct(F.lit(series).alias("series"), at.cast("long").alias("at"), F.lit(turn).alias("turn"), F.lit(reach).cast("long").alias("reach"))
    # Series 0 has starts, and asks for those before a place; series 1 has ends, and asks for those up to a place.
    points = [point(0, F.col("start"), 1, None), point(1, F.col("end"), 0, None)]
    for cutoff in sorted({c for _, c in facts.values()}):
        points += [point(0, F.col("end") + cutoff, 0, cutoff), point(1, F.col("start") - cutoff, 1, cutoff)]
    spread = rows.select(*GENE, *[F.col(f).cast("long").alias(f) for f in flags], F.explode(F.array(*points)).alias("p")).select(*GENE, *flags, "p.*")
    sources = spread.withColumns({f"_s_{f}": F.when(F.col("reach").isNull(), F.col(f)).otherwise(0) for f in flags})
    summed = running(sources, ["record_id", "series"], ["at", "turn"], {f"_b_{f}": (f"_s_{f}", F.sum) for f in flags})
    sign = F.when(F.col("series") == 0, 1).otherwise(-1)
    total = lambda flag, cutoff: F.sum(F.when(F.col("reach") == cutoff, sign * F.coalesce(f"_b_{flag}", F.lit(0))).otherwise(0)) - F.max(flag)
    return summed.where("reach is not null").groupBy(*GENE).agg(*[total(*fact).alias(name) for name, fact in facts.items()])


def _on_circles(rows: DataFrame, facts: Mapping[str, tuple[str, int]], lengths: DataFrame) -> DataFrame:
    flags = sorted({flag for flag, _ in facts.values()})
    reach = max(c for _, c in facts.values())
    some = F.greatest(*[F.col(f).cast("int") for f in flags], F.lit(0)) > 0
    pairs = near_join(rows.select(*GENE, "start", "end"), rows.where(some).select(*GENE, "start", "end", *flags), reach, max(1, reach), lengths, within=lambda a, b: F.col(f"{a}.gene_id") != F.col(f"{b}.gene_id"))
    total = lambda flag, cutoff: F.sum(F.when((F.col("distance") < cutoff) | (F.col("distance") == 0), F.col(f"r.{flag}").cast("long")).otherwise(0))
    found = pairs.groupBy("record_id", F.col("l.gene_id").alias("gene_id")).agg(*[total(*fact).alias(name) for name, fact in facts.items()])
    return rows.select(*GENE).join(found, GENE, "left").fillna(0, list(facts))

"""Joins and groups of half-open intervals ``[start, end)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .ordering import running, small_keys


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_width: int, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), within: Callable[[str, str], Column] | None = None, how: str = "overlap") -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap, as ``l`` and ``r`` struct columns beside the keys.

    Both sides are exploded into bins and joined on (keys, bin), a hash join without a nested loop; a pair is kept only in
    the bin where its overlap begins, so nothing has to be made distinct. Intervals should span
    few bins. ``within(l, r)`` adds a condition to the join; ``how`` is ``overlap`` or ``contain`` (left holds right).
    """

    def binned(df: DataFrame, side: str, span: tuple[str, str]) -> DataFrame:
        low, high = F.floor(F.col(span[0]) / bin_width), F.floor(F.greatest(F.col(span[1]) - 1, F.col(span[0])) / bin_width)
        packed = df.select(*keys, F.struct(*df.columns).alias(side), low.alias("_low"), high.alias("_high"))
        return packed.select(*keys, side, F.col("_low").alias(f"_first_{side}"), F.explode(F.sequence("_low", "_high")).alias("_bin"))

    meets = (F.col(f"l.{left_span[0]}") < F.col(f"r.{right_span[1]}")) & (F.col(f"r.{right_span[0]}") < F.col(f"l.{left_span[1]}"))
    if how == "contain":
        meets = (F.col(f"l.{left_span[0]}") <= F.col(f"r.{right_span[0]}")) & (F.col(f"r.{right_span[1]}") <= F.col(f"l.{left_span[1]}"))
    joined = binned(left, "l", left_span).join(binned(right, "r", right_span), [*keys, "_bin"])
    kept = joined.where((F.col("_bin") == F.greatest("_first_l", "_first_r")) & meets)
    if within is not None:
        kept = kept.where(within("l", "r"))
    return kept.select(*keys, "l", "r")


def near_join(left: DataFrame, right: DataFrame, reach: int | Column, bin_width: int, lengths: DataFrame | None = None, within: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs of rows of one ``record_id`` less than ``reach`` apart, as ``l`` and ``r`` structs with their ``distance`` (0 where they overlap).

    On circular records (``lengths``: ``record_id, length, circular``) rows are arcs, which may end past the length, and the distance is the
    shorter way round. Left arcs are widened by ``reach``, a column of the left rows or a number; both sides are exploded into the bins they cover, on circles
    by the place on the circle, so that the two sides of the origin share bins. A pair is kept in the bin where its overlap begins only.
    """
    reach = reach if isinstance(reach, Column) else F.lit(reach)

    def sided(df: DataFrame, side: str, by: Column) -> DataFrame:
        packed = df.select("record_id", F.struct(*df.columns).alias(side), by.cast("long").alias(f"_by_{side}"))
        if lengths is None:
            packed = packed.withColumn(f"_ring_{side}", F.lit(None).cast("long"))
        else:
            packed = packed.join(lengths.where("circular").select("record_id", F.col("length").cast("long").alias(f"_ring_{side}")), "record_id", "left")
        ring, start = F.col(f"_ring_{side}"), F.col(f"{side}.start") - F.col(f"_by_{side}")
        size = F.greatest(F.col(f"{side}.end") - F.col(f"{side}.start"), F.lit(1)) + 2 * F.col(f"_by_{side}")
        placed = packed.withColumns({f"_at_{side}": F.when(ring.isNull(), start).otherwise(F.pmod(start, ring)), f"_size_{side}": F.when(ring.isNull(), size).otherwise(F.least(size, ring))})
        bin_of = lambda x: F.floor(x / bin_width)
        at, end = F.col(f"_at_{side}"), F.col(f"_at_{side}") + F.col(f"_size_{side}")
        straight = F.sequence(bin_of(at), bin_of(end - 1))
        turned = F.array_distinct(F.concat(F.sequence(bin_of(at), bin_of(ring - 1)), F.sequence(F.lit(0).cast("long"), bin_of(end - ring - 1))))
        return placed.withColumn("_bin", F.explode(F.when(ring.isNull() | (end <= ring), straight).otherwise(turned)))

    none = F.lit(0)
    joined = sided(left, "l", reach).join(sided(right, "r", none).drop("_ring_r"), ["record_id", "_bin"])
    ring, at_l, at_r = F.col("_ring_l"), F.col("_at_l"), F.col("_at_r")
    # Where the overlap begins: at the right row's start if that lies in the left one, else at the left row's.
    after_l, after_r = F.when(ring.isNull(), at_r - at_l).otherwise(F.pmod(at_r - at_l, ring)), F.when(ring.isNull(), at_l - at_r).otherwise(F.pmod(at_l - at_r, ring))
    starts_in_l = (after_l >= 0) & (after_l < F.col("_size_l"))
    meets = starts_in_l | ((after_r >= 0) & (after_r < F.col("_size_r")))
    joined = joined.where(meets & (F.col("_bin") == F.floor(F.when(starts_in_l, at_r).otherwise(at_l) / bin_width)))
    ahead, behind = F.col("r.start") - F.col("l.end"), F.col("l.start") - F.col("r.end")
    size_l, size_r = F.col("l.end") - F.col("l.start"), F.col("r.end") - F.col("r.start")
    from_l, from_r = F.pmod(F.col("r.start") - F.col("l.start"), ring), F.pmod(F.col("l.start") - F.col("r.start"), ring)
    round_trip = F.when((from_l < size_l) | (from_r < size_r), F.lit(0).cast("long")).otherwise(F.least(from_l - size_l, from_r - size_r))
    distance = F.when(ring.isNull(), F.greatest(F.lit(0).cast("long"), ahead, behind)).otherwise(round_trip)
    kept = joined.withColumn("distance", distance).where((F.col("distance") < F.col("_by_l")) | (F.col("distance") == 0))
    if within is not None:
        kept = kept.where(within("l", "r"))
    return kept.select("record_id", "l", "r", "distance")


def islands(df: DataFrame, keys: Sequence[str], gap: int | Column = 0, strict: bool = True, start: str = "start", end: str = "end", order: Sequence[str] = (), into: str = "island", spread: bool = True, most: int | None = None) -> DataFrame:
    """Number the groups of intervals, per key in order of start, that follow each other at less than ``gap``.

    ``strict`` starts a new island where the distance to all earlier rows reaches ``gap``, else where it exceeds it.
    Keys with many rows are dealt over range partitions, so that one which holds a large share of all rows is many tasks. Where the stored rows are
    counted and no key has more than ``most`` (default: ``SMALL``) of them, and without ``spread``, where keys are known to be small, a key's rows meet in one task instead, by one shuffle.
    """
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    sort = [start, end, *order]
    distance = F.col(start) - F.col("_reach")
    begins = F.col("_reach").isNull() | (distance >= gap if strict else distance > gap)
    if spread:
        df = cut(df)
    if spread and not small_keys(df, keys, most):
        reached = running(df, keys, sort, {"_reach": (end, F.max)}, keep=True)
        marked = reached.withColumn("_begins", begins.cast("long"))
        # Of rows that tie in all of the order the one that begins comes first here too.
        numbered = running(marked, keys, [*sort, F.col("_begins").desc()], {"_earlier": ("_begins", F.sum)}, dealt=True)
        return numbered.withColumn(into, F.coalesce("_earlier", F.lit(0)) + F.col("_begins") - 1).drop("_reach", "_begins", "_earlier")
    w = Window.partitionBy(*keys).orderBy(*sort)
    reached = df.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return reached.withColumn(into, F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_reach")


def close_circles(marked: DataFrame, keys: Sequence[str], lengths: DataFrame, gap: int | Column = 0, strict: bool = True, start: str = "start", end: str = "end", into: str = "island") -> DataFrame:
    """Join a key's first and last island where they meet over the origin of a circular record.

    ``lengths`` has ``record_id, length, circular``, and ``record_id`` is among the keys. Rows of the first island then
    go behind the last one: their coordinates grow by the length, so a span over the origin is one interval that ends past it.
    """
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    spans = marked.groupBy(*keys, into).agg(F.min(start).alias("low"), F.max(end).alias("high"), F.max(gap).alias("gap"))
    ends = spans.groupBy(*keys).agg(F.min(into).alias("_first"), F.max(into).alias("_last"), F.min_by("low", into).alias("low"), F.max_by("high", into).alias("high"), F.max("gap").alias("gap"))
    over = F.col("low") + F.col("length") - F.col("high")
    near = (over < F.col("gap")) if strict else (over <= F.col("gap"))
    met = ends.join(lengths.where("circular").select("record_id", "length"), "record_id").where((F.col("_first") < F.col("_last")) & near).select(*keys, "_first", "_last", F.col("length").alias("_length"))
    joined = marked.join(met, list(keys), "left")
    moved = F.coalesce(F.col(into) == F.col("_first"), F.lit(False))
    shifted = {c: F.when(moved, F.col(c) + F.col("_length")).otherwise(F.col(c)) for c in (start, end)}
    return joined.withColumns(shifted | {into: F.when(moved, F.col("_last")).otherwise(F.col(into))}).drop("_first", "_last", "_length")


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], merge: Callable[[Column, Column], Column], into: str = "kept") -> DataFrame:
    """Scan each key's rows in order with ``merge(list so far, row)`` and return the rows of the final list.

    Rows are structs of the order columns, then the payload. A key's rows are one array in the JVM, so keys are to be small units
    such as genes or areas, never whole records.
    """
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *payload])])
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("_rows"))
    folded = F.aggregate("_rows", F.slice("_rows", 1, 0), merge)
    return rows.select(*keys, F.inline(folded))

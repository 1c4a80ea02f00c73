"""Locations as structs: ``parts`` (array of ``start, end, strand``) in biological order on circular records.

All functions take and return Columns. Coordinates are 0-based and half-open. A location crosses the origin
where a part begins before the part that precedes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<start:bigint,end:bigint,strand:int>"


def part(start: Column, end: Column, strand: Column | int = 1) -> Column:
    """One part."""
    strand = strand if isinstance(strand, Column) else F.lit(strand)
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), strand.cast("int").alias("strand"))


def overlaps(a: Column, b: Column) -> Column:
    """Any part of one overlaps any part of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def contains(outer: Column, inner: Column) -> Column:
    """Every inner part lies in some outer part."""
    return F.forall(inner, lambda x: F.exists(outer, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))


def distance(a: Column, b: Column, wrap: Column | None = None) -> Column:
    """0 where they overlap, else the least gap between parts; over the origin too where a record's length is given."""

    def gap(x: Column, y: Column) -> Column:
        direct = F.greatest(y["start"] - x["end"], x["start"] - y["end"])
        if wrap is None:
            return F.greatest(direct, F.lit(0).cast("bigint"))
        around = wrap - F.greatest(x["end"], y["end"]) + F.least(x["start"], y["start"])
        return F.greatest(F.least(direct, around), F.lit(0).cast("bigint"))

    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: gap(x, y))))
    return F.when(overlaps(a, b), F.lit(0).cast("bigint")).otherwise(F.array_min(gaps))


def size(parts: Column) -> Column:
    """Bases covered."""
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: total + p["end"] - p["start"])


def crosses_origin(parts: Column) -> Column:
    """Whether some part begins before the part that precedes it (against the strand on the reverse one)."""
    steps = F.sequence(F.lit(2), F.size(parts))
    forward = F.exists(steps, lambda k: F.element_at(parts, k)["start"] < F.element_at(parts, k - 1)["start"])
    reverse = F.exists(steps, lambda k: F.element_at(parts, k)["start"] > F.element_at(parts, k - 1)["start"])
    return F.when(F.size(parts) < 2, F.lit(False)).when(F.element_at(parts, 1)["strand"] == -1, reverse).otherwise(forward)


def split_origin(parts: Column) -> tuple[Column, Column]:
    """Parts before the origin (at the record's end) and after it, for a crossing location."""
    steps = F.sequence(F.lit(2), F.size(parts))
    reverse = F.element_at(parts, 1)["strand"] == -1
    turn = F.array_min(F.filter(steps, lambda k: F.when(reverse, F.element_at(parts, k)["start"] > F.element_at(parts, k - 1)["start"]).otherwise(F.element_at(parts, k)["start"] < F.element_at(parts, k - 1)["start"])))
    head, tail = F.slice(parts, F.lit(1), turn - 1), F.slice(parts, turn, F.size(parts) - turn + 1)
    return F.when(reverse, tail).otherwise(head), F.when(reverse, head).otherwise(tail)


def extend(parts: Column, by: Column | int, length: Column, circular: Column) -> Column:
    """The forward hull of a location widened on both sides: clamped on linear records, wrapped on circular ones.

    On a circular record it becomes two parts where it crosses the origin, and the whole record where the sides meet.
    """
    by = (by if isinstance(by, Column) else F.lit(by)).cast("bigint")
    crossing = crosses_origin(parts)
    upper, lower = split_origin(parts)
    starts = lambda some: F.array_min(F.transform(some, lambda p: p["start"]))
    ends = lambda some: F.array_max(F.transform(some, lambda p: p["end"]))
    low = F.when(crossing, starts(upper)).otherwise(starts(parts)) - by
    high = F.when(crossing, ends(lower)).otherwise(ends(parts)) + by
    zero = F.lit(0).cast("bigint")
    whole = F.array(part(zero, length))
    around = F.array(part(F.pmod(low, length), length), part(zero, F.pmod(high - 1, length) + 1))
    meets = F.when(crossing, low <= high).otherwise(high - low >= length)
    wraps = crossing | (low < 0) | (high > length)
    on_circle = F.when(meets, whole).when(wraps, around).otherwise(F.array(part(low, high)))
    return F.when(circular, on_circle).otherwise(F.array(part(F.greatest(zero, low), F.least(length, high))))


def hull_linear(parts: Column) -> Column:
    """The smallest single part that covers all parts."""
    return F.array(part(F.array_min(F.transform(parts, lambda p: p["start"])), F.array_max(F.transform(parts, lambda p: p["end"]))))


def hull(parts: Column, length: Column, circular: Column) -> Column:
    """The smallest location that covers all parts; on a circular record it may go over the origin.

    For few parts; ``hulls`` does the same for groups. It is what is left when the largest gap between neighbouring parts is taken from the circle; the gap around the origin wins ties.
    """
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    first, last = F.element_at(ordered, 1)["start"], F.array_max(F.transform(ordered, lambda p: p["end"]))
    reach = lambda k: F.array_max(F.transform(F.slice(ordered, F.lit(1), k - 1), lambda p: p["end"]))
    gaps = F.transform(F.sequence(F.lit(2), F.size(ordered)), lambda k: F.struct((F.element_at(ordered, k)["start"] - reach(k)).alias("gap"), (-k).alias("order"), reach(k).alias("end"), F.element_at(ordered, k)["start"].alias("start")))
    widest = F.array_max(gaps)
    over = circular & (F.size(ordered) > 1) & (widest["gap"] > first + length - last)
    return F.when(over, F.array(part(widest["start"], length), part(F.lit(0), widest["end"]))).otherwise(F.array(part(first, last)))


def hulls(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same hull for each key's rows (``start, end, length, circular``), for groups of any size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reached = rows.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_place", F.row_number().over(w))
    gap = F.when(F.col("_reach").isNotNull(), F.struct((F.col("start") - F.col("_reach")).alias("gap"), (-F.col("_place")).alias("order"), F.col("_reach").alias("end"), F.col("start").alias("start")))
    found = reached.groupBy(*keys).agg(F.min("start").alias("first"), F.max("end").alias("last"), F.max(gap).alias("widest"), F.first("length").alias("length"), F.first("circular").alias("circular"))
    widest = F.col("widest")
    over = F.col("circular") & widest.isNotNull() & (widest["gap"] > F.col("first") + F.col("length") - F.col("last"))
    around = F.array(part(widest["start"], F.col("length")), part(F.lit(0), widest["end"]))
    return found.select(*keys, F.when(over, around).otherwise(F.array(part(F.col("first"), F.col("last")))).alias("hull"))


def offset(parts: Column, by: Column | int, length: Column | None = None) -> Column:
    """Every part moved; with a length, over the origin too, cutting a part that would cross it and joining parts that meet."""
    by = (by if isinstance(by, Column) else F.lit(by)).cast("bigint")
    if length is None:
        return F.transform(parts, lambda p: part(p["start"] + by, p["end"] + by, p["strand"]))

    def moved(p: Column) -> Column:
        start = F.pmod(p["start"] + by, length)
        end = start + p["end"] - p["start"]
        pieces = F.array(part(start, length, p["strand"]), part(F.lit(0), end - length, p["strand"]))
        return F.when(end <= length, F.array(part(start, end, p["strand"]))).when(p["strand"] == -1, F.reverse(pieces)).otherwise(pieces)

    def join(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (last["strand"] == p["strand"]) & F.when(p["strand"] == -1, last["start"] == p["end"]).otherwise(last["end"] == p["start"])
        both = part(F.least(last["start"], p["start"]), F.greatest(last["end"], p["end"]), p["strand"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(F.flatten(F.transform(parts, moved)), F.array().cast(f"array<{PART}>"), join)


def frameshift(parts: Column, codon_start: Column) -> Column:
    """The 5' edge moved inwards so that translation begins at ``codon_start`` (1 to 3)."""
    by = (codon_start - 1).cast("bigint")
    head = F.element_at(parts, 1)
    moved = F.when(head["strand"] == -1, part(head["start"], head["end"] - by, head["strand"])).otherwise(part(head["start"] + by, head["end"], head["strand"]))
    return F.concat(F.array(moved), F.slice(parts, F.lit(2), F.size(parts)))


def protein_to_dna(parts: Column, start: Column, end: Column) -> Column:
    """The nucleotide parts of residues ``[start, end)``, over exons in biological order on either strand. One walk over the exons carries the bases before each."""
    low, high, zero = (start * 3).cast("bigint"), (end * 3).cast("bigint"), F.lit(0).cast("bigint")

    def step(done: Column, p: Column) -> Column:
        before, n = done["before"], p["end"] - p["start"]
        a, b = F.greatest(low - before, zero), F.least(high - before, n)
        clipped = F.when(p["strand"] == -1, part(p["end"] - b, p["end"] - a, p["strand"])).otherwise(part(p["start"] + a, p["start"] + b, p["strand"]))
        return F.struct((before + n).alias("before"), F.when((a < b) & n.isNotNull(), F.concat(done["found"], F.array(clipped))).otherwise(done["found"]).alias("found"))

    return F.aggregate(parts, F.struct(zero.alias("before"), F.array().cast(f"array<{PART}>").alias("found")), step, lambda done: done["found"])


def drop_redundant_exons(parts: Column) -> Column:
    """Parts that lie in no larger part; of equal ones the first."""

    def kept(p: Column, k: Column) -> Column:
        # A part that holds another is larger, but for an equal one.
        holds = lambda q, j: (j != k) & (q["start"] <= p["start"]) & (p["end"] <= q["end"]) & ((q["start"] < p["start"]) | (p["end"] < q["end"]) | (j < k))
        return ~F.exists(F.transform(parts, holds), lambda x: x)

    return F.filter(parts, kept)


def format_location(parts: Column) -> Column:
    """``[1:6](-)``, or ``join{...}`` over several parts."""
    sign = lambda s: F.when(s == 1, "(+)").when(s == -1, "(-)").otherwise("")
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p["start"].cast("string"), F.lit(":"), p["end"].cast("string"), F.lit("]"), sign(p["strand"]))), ", ")
    return F.when(F.size(parts) == 1, text).otherwise(F.concat(F.lit("join{"), text, F.lit("}")))


def parse_location(text: Column) -> Column:
    """The parts that ``format_location`` wrote; open ends (``<``, ``>``) lose their mark. The text is searched once, for whole parts."""
    found = F.regexp_extract_all(text, F.lit(r"\[[<>]?\d+:[<>]?\d+\](?:\([+-]\))?"), F.lit(0))

    def read(one: Column) -> Column:
        start = F.ltrim(F.substring_index(one, ":", 1), F.lit("[<>"))
        end = F.ltrim(F.substring_index(F.substring_index(one, ":", -1), "]", 1), F.lit("<>"))
        return part(start, end, F.when(F.endswith(one, F.lit("(+)")), 1).when(F.endswith(one, F.lit("(-)")), -1).otherwise(0))

    return F.transform(found, read)


def order_key(parts: Column) -> Column:
    """Sort key of features: (start, end), crossing ones first by the negative length before the origin."""
    upper, lower = split_origin(parts)
    span = F.element_at(hull_linear(parts), 1)
    crossing = F.struct((-size(upper)).alias("a"), F.array_max(F.transform(lower, lambda p: p["end"])).alias("b"))
    return F.when(crosses_origin(parts), crossing).otherwise(F.struct(span["start"].alias("a"), span["end"].alias("b")))

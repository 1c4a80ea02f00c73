"""Cleaning of sequences and features, and skip marks.

Sequences have ``record_id, idx, seq`` and ``skip_reason`` (null: in use).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals

#: Characters that may not stand in an identifier.
ILLEGAL = "!\"#$%&()*+,:;=>?@[]^`'{|}/ "
#: Patterns of contig and scaffold numbers in an identifier, in the order in which they are tried.
NUMBERED = (r"onti?g?(\d+)\b", r"caff?o?l?d?(\d+)\b", r"\bc(\d+)\b")


def sanitise(sequences: DataFrame) -> DataFrame:
    """Upper case, no gaps, N for anything but ACGT; without any of ACGT a record is skipped."""
    clean = F.regexp_replace(F.regexp_replace(F.upper("seq"), "-", ""), "[^ACGT]", "N")
    return sequences.withColumn("seq", clean).withColumn("skip_reason", F.when(~F.col("seq").rlike("[ACGT]"), "contains no sequence").otherwise(F.col("skip_reason")))


def nucleotide_share(seq: str = "seq"):
    """The share of a sequence that is ACGTN or a gap."""
    text = F.lower(seq)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^acgtn-]", "")) / F.length(text)).otherwise(0.0)


def looks_nucleotide(sequences: DataFrame, share: float = 0.9) -> DataFrame:
    """Add ``is_nucleotide``: no more than a tenth of the sequence are other letters."""
    return sequences.withColumn("is_nucleotide", nucleotide_share() >= share)


def require_nucleotide(sequences: DataFrame, share: float = 0.9) -> DataFrame:
    """The same rows; a record that looks like a protein is an error."""
    return sequences.where(F.assert_true(nucleotide_share() >= share, F.lit("protein records are not supported")).isNull())


def mark_short(sequences: DataFrame, minlength: int = 1000) -> DataFrame:
    """Skip records under a length."""
    return sequences.withColumn("skip_reason", F.when(F.length("seq") < minlength, f"smaller than minimum length ({minlength})").otherwise(F.col("skip_reason")))


def limit_to_record(sequences: DataFrame, name: int | str) -> DataFrame:
    """Skip all records but one; that one has to exist."""
    if sequences.where(F.col("record_id") == name).isEmpty():
        raise ValueError(f"no record matches {name}")
    return sequences.withColumn("skip_reason", F.when(F.col("record_id") != name, "did not match the record to be kept").otherwise(F.col("skip_reason")))


def limit_largest(sequences: DataFrame, n: int) -> DataFrame:
    """Skip all but the ``n`` longest records in use; earlier ones win ties.

    Only ids and lengths are ranked, and only ``n`` rows leave that ranking.
    """
    kept = sequences.where("skip_reason is null").select("record_id", F.length("seq").alias("_length"), "idx").orderBy(F.desc("_length"), "idx").limit(n).select("record_id", F.lit(True).alias("_kept"))
    joined = sequences.join(kept, "record_id", "left")
    return joined.withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & F.col("_kept").isNull(), f"skipping all but largest {n} records").otherwise(F.col("skip_reason"))).drop("_kept")


def trim(sequences: DataFrame, features: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Sequences cut to ``[start, end)`` and the features inside, moved along."""
    cut = sequences.withColumn("seq", F.substring("seq", start + 1, end - start))
    inside = features.where((F.col("start") >= start) & (F.col("end") <= end))
    return cut, inside.withColumns({"start": F.col("start") - start, "end": F.col("end") - start})


def _with_numbers(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``idx, id`` of rows (``idx, stem``): the stem, ``_`` and, in order of ``idx``, the least numbers that make no id in ``taken`` (``id``)."""
    placed = prefix_totals(rows, ["stem"], ["idx"], rows="place")
    asked = placed.groupBy("stem").agg(F.count("*").alias("n"))
    split = taken.select(F.regexp_extract("id", r"(?s)^(.*)_(0|[1-9][0-9]{0,17})$", 1).alias("stem"), F.regexp_extract("id", r"(?s)^(.*)_(0|[1-9][0-9]{0,17})$", 2).alias("number")).where("number <> ''")
    used = split.join(asked.select("stem"), "stem", "left_semi").select("stem", F.col("number").cast("long").alias("number")).distinct()
    sizes = asked.join(used.groupBy("stem").agg(F.count("*").alias("m")), "stem", "left")
    every = sizes.select("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.coalesce("m", F.lit(0)) - 1)).alias("number"))
    free = prefix_totals(every.join(used, ["stem", "number"], "left_anti"), ["stem"], ["number"], rows="place")
    return placed.join(free, ["stem", "place"]).select("idx", F.concat("stem", F.lit("_"), F.col("number").cast("string")).alias("id"))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key (``idx``, key) the one with the least ``idx``."""
    return rows.groupBy(key).agg(F.min("idx").alias("idx"))


def normalise_ids(sequences: DataFrame, id_column: str = "name", longest: int = 16) -> DataFrame:
    """Add ``new_id``: without illegal characters, unique, and shortened over ``longest`` characters. ``idx`` has to be unique.

    In order of ``idx``: the first of equal ids keeps it, the others get ``_`` and the least free number; a number never makes an id that
    another record was given. Of a long id first the part before a version (``.`` and one character) is
    tried, then ``c``, five digits (a contig or scaffold number, else the record's 1-based place), ``_``, the first seven characters
    and ``..``; where that is taken, its first twelve characters and a free number stand (over ``longest`` again only past a thousand of them).
    A null name counts as empty.
    """
    given = sequences.select(F.col("idx").cast("long").alias("idx"), F.coalesce(F.translate(F.col(id_column), ILLEGAL, ""), F.lit("")).alias("id"))
    placed = prefix_totals(given, ["id"], ["idx"], rows="again")
    kept = placed.where("again = 0").select("idx", "id")
    unique = cut(kept.unionByName(_with_numbers(placed.where("again > 0").select("idx", F.col("id").alias("stem")), kept)))

    long = unique.where(F.length("id") > longest)
    bare = long.select("idx", F.regexp_extract("id", r"(?s)^([^.]*)\.[^.]$", 1).alias("bare")).where(F.length("bare").between(1, longest))
    bare = _first(bare.join(unique.select(F.col("id").alias("bare")), "bare", "left_anti"), "bare").select("idx", F.col("bare").alias("new_id"))
    rest = long.join(bare, "idx", "left_anti")
    found = F.coalesce(*[F.nullif(F.regexp_extract("id", p, 1), F.lit("")) for p in NUMBERED])
    number = F.coalesce(found.try_cast("bigint"), F.col("idx") + 1).cast("string")
    shape = F.concat(F.lit("c"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 5 - F.length(number))), number, F.lit("_"), F.substring("id", 1, 7), F.lit(".."))
    short = rest.select("idx", shape.alias("short")).join(unique.select(F.col("id").alias("short")), "short", "left_anti")
    short = _first(short, "short").select("idx", F.col("short").alias("new_id"))
    last = rest.join(short, "idx", "left_anti").select("idx", F.substring("id", 1, longest - 4).alias("stem"))
    taken = unique.select("id").unionByName(bare.select(F.col("new_id").alias("id")))
    changed = cut(bare.unionByName(short).unionByName(_with_numbers(last, taken).select("idx", F.col("id").alias("new_id"))))
    named = unique.join(changed, "idx", "left").select("idx", F.coalesce("new_id", "id").alias("new_id"))
    return sequences.join(named, "idx")


def strip_annotations(features: DataFrame, kinds: Sequence[str], qualifiers: Sequence[str]) -> DataFrame:
    """Features that are not of the kinds, without the qualifiers."""
    return features.where(~F.col("type").isin(*kinds)).withColumn("qualifiers", F.map_filter("qualifiers", lambda k, _: ~k.isin(*qualifiers)))


def check_locations(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """``record_id, feature_id, problem`` of features (with ``parts``) that lie outside, lack a location, share a stop or have exons out of order."""
    parts = F.col("parts")
    stops = F.transform(parts, lambda p: F.when(p["strand"] == -1, p["start"]).otherwise(p["end"]))
    starts = F.transform(parts, lambda p: p["start"])
    ascending, descending = F.sort_array(starts), F.sort_array(starts, asc=False)
    problem = (
        F.when(parts.isNull() | (F.size(parts) == 0), "missing location")
        .when(F.exists(parts, lambda p: p["end"] > F.col("length")), "outside the record")
        .when(F.size(F.array_distinct(stops)) < F.size(stops), "exons share a stop")
        .when(~F.col("circular") & (starts != ascending) & (starts != descending), "inconsistent exon order")
    )
    return features.join(lengths, "record_id").withColumn("problem", problem).where("problem is not null").select("record_id", "feature_id", "problem")


def filter_gene_calls(calls: DataFrame, lengths: DataFrame, longest: int = 300_000) -> DataFrame:
    """Gene calls on a doubled circular record: none that begins after the wrap point, is too long, or lies in the last call that crosses it."""
    inside = calls.join(lengths, "record_id").where((F.col("start") < F.col("length")) & (F.col("end") - F.col("start") <= longest))
    over = inside.where("end > length").groupBy("record_id").agg(F.max(F.col("end") - F.col("length")).alias("_over"))
    return inside.join(over, "record_id", "left").where("_over is null or end > length or end > _over").drop("_over", "length")


def mark_skipped(sequences: DataFrame, features: DataFrame, regions: DataFrame) -> DataFrame:
    """Skip records without genes, and those without regions."""
    genes = features.select("record_id").distinct().withColumn("_genes", F.lit(True))
    areas = regions.select("record_id").distinct().withColumn("_regions", F.lit(True))
    joined = sequences.join(genes, "record_id", "left").join(areas, "record_id", "left")
    reason = F.when(F.col("_genes").isNull(), "no genes found").when(F.col("_regions").isNull(), "no regions found").otherwise(F.col("skip_reason"))
    return joined.withColumn("skip_reason", reason).drop("_genes", "_regions")

"""Joins of features, areas, hits and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import near_join, range_join
from ..plans.ordering import with_adjacent


def within(features: DataFrame, areas: DataFrame, bin_width: int, with_overlapping: bool = False) -> DataFrame:
    """``record_id, area_id, gene_id``: genes inside areas, or also those that only overlap."""
    pairs = range_join(areas.select("record_id", "area_id", "start", "end"), features.select("record_id", "gene_id", "start", "end"), ["record_id"], bin_width, how="overlap" if with_overlapping else "contain")
    return pairs.select("record_id", F.col("l.area_id").alias("area_id"), F.col("r.gene_id").alias("gene_id"))


def neighbours(features: DataFrame, cutoff: int, lengths: DataFrame | None = None) -> DataFrame:
    """``record_id, a, b, distance`` of genes less than the cutoff apart, once per pair; with ``lengths`` the shorter way round on circular records."""
    rows = features.select("record_id", "gene_id", "start", "end")
    pairs = near_join(rows, rows, cutoff, max(1, cutoff), lengths, within=lambda a, b: F.col(f"{a}.gene_id") < F.col(f"{b}.gene_id"))
    return pairs.select("record_id", F.col("l.gene_id").alias("a"), F.col("r.gene_id").alias("b"), "distance")


def nearest_with_profile(features: DataFrame, hits: DataFrame, profiles: Sequence[str], max_range: int = 40000, lengths: DataFrame | None = None) -> DataFrame:
    """``record_id, gene_id, distance`` to the closest gene with one of the profiles in range, -1 without; on circular records the shorter way round."""
    rows = features.select("record_id", "gene_id", "start", "end")
    named = rows.join(hits.where(F.col("profile").isin(*profiles)).select("record_id", "gene_id").distinct(), ["record_id", "gene_id"])
    least = near_join(rows, named, max_range, max_range, lengths).groupBy("record_id", F.col("l.gene_id").alias("gene_id")).agg(F.min("distance").alias("distance"))
    return rows.select("record_id", "gene_id").join(least, ["record_id", "gene_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(-1).cast("long")))


def map_ontology(hits: DataFrame, ontology: DataFrame) -> DataFrame:
    """Hits with the terms (``profile, term_id``) of their profile."""
    return hits.join(ontology, "profile")


def resolve_reference_hits(alignments: DataFrame, reference_genes: DataFrame) -> DataFrame:
    """Alignments with every reference area (``ref_gene, area``) that holds the gene."""
    return alignments.join(reference_genes, "ref_gene")


def hits_in_area(alignments: DataFrame, members: DataFrame) -> DataFrame:
    """Alignments whose query is a member of an area."""
    return alignments.join(members.select("query_id").distinct(), "query_id", "left_semi")


def drop_self_hits(ranking: DataFrame) -> DataFrame:
    """Rankings without references that are the query's own record (its version cut off)."""
    return ranking.where(F.col("accession") != F.split_part(F.col("record_name"), F.lit("."), F.lit(1)))


def annotate_subtypes(hits: DataFrame, subtype_hits: DataFrame, target: str) -> DataFrame:
    """Hits of the target profile with ``subtypes``: profiles, without a trailing ``_n``, of secondary hits that overlap them on the gene."""
    mine = hits.where(F.col("profile") == target)
    other = subtype_hits.select("record_id", "gene_id", F.regexp_replace("profile", r"_\d+$", "").alias("subtype"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    pairs = mine.join(other, ["record_id", "gene_id"]).where((F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end")))
    found = pairs.groupBy("record_id", "ord").agg(F.sort_array(F.collect_set("subtype")).alias("subtypes"))
    return mine.join(found, ["record_id", "ord"], "left").withColumn("subtypes", F.coalesce("subtypes", F.array().cast("array<string>")))


def followers(features: DataFrame) -> DataFrame:
    """``record_id, gene_id, follower``: the next gene in the direction of transcription, where it is on the same strand."""
    near = with_adjacent(features, ["record_id"], ["start", "end", "gene_id"], ["gene_id", "strand"])
    chosen = F.when(F.col("strand") == -1, F.col("before")).otherwise(F.col("after"))
    return near.select("record_id", "gene_id", F.when(chosen["strand"] == F.col("strand"), chosen["gene_id"]).alias("follower"))


def areas_by_gene(features: DataFrame, names: DataFrame, lengths: DataFrame, padding: int = 20000) -> DataFrame:
    """``gene_id, record_id, start, end`` around named genes (``gene_id``); unknown names keep nulls.

    ``lengths`` has ``record_id, length`` and perhaps ``circular``. Areas stay inside linear records. On circular ones they go over the origin, as one
    interval that ends past the length, and are the whole record where the sides meet.
    """
    circular = F.coalesce("circular", F.lit(False)) if "circular" in lengths.columns else F.lit(False)
    found = names.join(features.select("record_id", "gene_id", "start", "end"), "gene_id", "left").join(lengths, "record_id", "left")
    size = F.col("end") - F.col("start") + 2 * padding
    low = F.when(size >= F.col("length"), F.lit(0).cast("long")).otherwise(F.pmod(F.col("start") - padding, "length"))
    start = F.when(circular, low).otherwise(F.greatest(F.col("start") - padding, F.when(F.col("start").isNotNull(), F.lit(0))))
    end = F.when(circular, low + F.least(size, "length")).otherwise(F.least(F.col("end") + padding, F.col("length")))
    return found.select("gene_id", "record_id", start.alias("start"), end.alias("end"))


def points_in_areas(points: DataFrame, areas: DataFrame, bin_width: int) -> DataFrame:
    """Points (``record_id, point_id, position``) that lie in an area, once each."""
    spots = points.select("record_id", "point_id", F.col("position").alias("start"), (F.col("position") + 1).alias("end"))
    pairs = range_join(areas.select("record_id", "start", "end"), spots, ["record_id"], bin_width)
    return pairs.select("record_id", F.col("r.point_id").alias("point_id"), F.col("r.start").alias("position")).distinct()


def empty_areas(areas: DataFrame, features: DataFrame, bin_width: int) -> DataFrame:
    """Areas without a gene inside."""
    return areas.join(within(features, areas, bin_width).select("record_id", "area_id").distinct(), ["record_id", "area_id"], "left_anti")


def annotate_functions(best_hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Best hits with the function of their profile, where the score reaches its ``min_score``."""
    return best_hits.join(metadata, "profile").where("score >= min_score").drop("min_score")

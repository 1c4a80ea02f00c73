"""Writers of areas, reports and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import range_join


def write_sequences(genes: DataFrame, path: str, parts: int | None = None) -> None:
    """``name, seq`` as FASTA text, in ``parts`` files if given."""
    lines = genes.select(F.format_string(">%s\n%s", "name", "seq").alias("value"))
    (lines.repartition(parts) if parts else lines).write.text(path)


def area_json(regions: DataFrame, areas: DataFrame, candidates: DataFrame, subregions: DataFrame | None = None) -> DataFrame:
    """One row per record: its regions, each with areas, candidates as places in the list of areas, and subregions.

    ``areas`` has ``region, area_id, product, start, end``; ``candidates`` has ``region, kind, start, end, area_ids``; ``subregions`` has ``region, label, start,
    end``. A region without one of them has an empty list. The object of a record is one row, as large as its regions' lists.
    """
    keys = ["record_id", "region"]
    listed = areas.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "area_id", "product"))).alias("areas"))
    chosen = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "area_ids"))).alias("candidates"))
    joined = regions.join(listed, keys, "left").join(chosen, keys, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    if subregions is None:
        joined = joined.withColumn("subregions", none)
    else:
        marked = subregions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label"))).alias("subregions"))
        joined = joined.join(marked, keys, "left").withColumn("subregions", F.coalesce("subregions", none))
    return region_json(joined)


def region_json(regions: DataFrame) -> DataFrame:
    """As ``area_json``, from one row per region with its sorted lists ``areas``, ``candidates`` (null: none) and ``subregions``; rows that are dealt by record stay where they are."""
    ids = F.transform("areas", lambda a: a["area_id"])
    placed = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.transform(c["area_ids"], lambda i: F.array_position(ids, i) - 1).alias("areas")))
    empty = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    kinds = {f.name: f.dataType.simpleString() for f in regions.select("areas", placed.alias("candidates")).schema.fields}
    rows = regions.select("record_id", F.struct("region", "start", "end", empty(F.col("areas"), kinds["areas"]).alias("areas"), empty(placed, kinds["candidates"]).alias("candidates"), "subregions").alias("r"))
    return rows.groupBy("record_id").agg(F.sort_array(F.collect_list("r")).alias("regions"))


def write_area_json(regions: DataFrame, areas: DataFrame, candidates: DataFrame, path: str, subregions: DataFrame | None = None, compression: str | None = None) -> None:
    """``area_json`` as JSON lines."""
    area_json(regions, areas, candidates, subregions).write.json(path, compression=compression)


def region_features(features: DataFrame, regions: DataFrame, lengths: DataFrame | None = None, bin_width: int = 20_000) -> DataFrame:
    """Features inside each region, rebased to its start; ``region``'s own columns are ``record_id, region, start, end``.

    On circular records (``lengths``: ``record_id, length, circular``) a region over the origin ends past the length; features behind the
    origin follow on those before it. Both sides are joined by bins.
    """
    turned = features.withColumn("_turn", F.lit(0).cast("long"))
    if lengths is not None:
        circles = lengths.where("circular").select("record_id", F.col("length").cast("long").alias("_turn"))
        turned = turned.unionByName(features.join(circles, "record_id"))
    turned = turned.withColumns({"start": F.col("start") + F.col("_turn"), "end": F.col("end") + F.col("_turn")})
    inside = range_join(regions.select("record_id", "region", "start", "end"), turned, ["record_id"], bin_width, how="contain")
    others = [F.col(f"r.{c}").alias(c) for c in features.columns if c not in ("record_id", "start", "end")]
    return inside.select("record_id", F.col("l.region").alias("region"), (F.col("r.start") - F.col("l.start")).alias("start"), (F.col("r.end") - F.col("l.start")).alias("end"), *others)


def write_region_features(features: DataFrame, regions: DataFrame, path: str, lengths: DataFrame | None = None) -> None:
    """``region_features`` as Parquet, one folder per record and region."""
    region_features(features, regions, lengths).write.partitionBy("record_id", "region").parquet(path)


def hit_report(ranking: DataFrame, pairs: DataFrame, query_genes: DataFrame, subject_genes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report, each with ``region``: ``ranking``; ``query_genes`` of the ranked regions; ``subject_genes`` and ``pairs`` of the ranked references only.

    ``ranking`` has ``region, ref_area, rank``; ``pairs`` has ``region, ref_area``; ``query_genes`` has ``region``; ``subject_genes`` has ``ref_area``.
    """
    ranked = ranking.select("region", "ref_area").distinct()
    return {
        "ranking": ranking,
        "query_genes": query_genes.join(ranked.select("region").distinct(), "region", "left_semi"),
        "subject_genes": subject_genes.join(ranked, "ref_area"),
        "pairs": pairs.join(ranked, ["region", "ref_area"], "left_semi"),
    }


def write_hit_report(ranking: DataFrame, pairs: DataFrame, path: str, query_genes: DataFrame | None = None, subject_genes: DataFrame | None = None) -> None:
    """Ranked references and their hit pairs, and with them the genes of both sides, as CSV by region."""
    tables = {"ranking": ranking, "pairs": pairs} if query_genes is None or subject_genes is None else hit_report(ranking, pairs, query_genes, subject_genes)
    for name, rows in tables.items():
        rows.write.partitionBy("region").csv(f"{path}/{name}", header=True)

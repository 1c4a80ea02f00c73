"""Predictions and summaries of areas, and domains of assembly-line genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import islands
from ..plans.ordering import prefix_totals, with_adjacent

GENE = ["record_id", "gene_id"]


def sum_predictions(predictions: DataFrame) -> DataFrame:
    """``area_id, name, score, evalue``: names split on ``/`` share their score; scores summed, the least e-value kept."""
    names = F.split("name", "/")
    shared = predictions.select("area_id", F.explode(names).alias("part"), (F.col("score") / F.size(names)).alias("score"), "evalue")
    return shared.groupBy("area_id", F.col("part").alias("name")).agg(F.sum("score").alias("score"), F.min("evalue").alias("evalue"))


def _held_by_all(rows: DataFrame, facts: DataFrame, owner: str, name: str) -> DataFrame:
    """``owner`` and the columns of ``facts`` (by ``name``) that all distinct names of an owner have.

    Names are few and owners many, so the facts go to the owners' rows; dealt by name, each name would be one task. Owners are dealt once.
    """
    named = rows.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.collect_set(name).alias("_names"), F.max(F.col(name).isNull().cast("int")).alias("_unnamed"))
    held = named.where("_unnamed = 0").select(owner, F.size("_names").alias("_needed"), F.explode("_names").alias(name)).join(F.broadcast(facts.distinct()), name)
    others = [c for c in facts.columns if c != name]
    return held.groupBy(owner, "_needed", *others).agg(F.count("*").alias("_held")).where("_held = _needed").select(owner, *others)


def common_classes(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """``area_id, class`` of classes (``name, class``; a table of rules, broadcast) that every prediction of an area has."""
    return _held_by_all(predictions, classes, "area_id", "name")


def mass_combinations(starters: DataFrame, elongations: DataFrame, tailoring: DataFrame) -> DataFrame:
    """``area_id, starter, elongation, mass``: every starter with every elongation of an area, and its tailoring added.

    An area has a handful of each, so the join by area stays small.
    """
    extra = tailoring.groupBy("area_id").agg(F.sum("weight").alias("extra"))
    pairs = starters.select("area_id", "starter", F.col("weight").alias("s")).join(elongations.select("area_id", "elongation", F.col("weight").alias("e")), "area_id")
    return pairs.join(extra, "area_id", "left").select("area_id", "starter", "elongation", (F.col("s") + F.col("e") + F.coalesce("extra", F.lit(0.0))).alias("mass"))


def prediction_table(hits: DataFrame, more: DataFrame, types: Sequence[str]) -> DataFrame:
    """Hits of both sources, their name split into type and function at the first ``_``, of the types asked for."""
    both = hits.unionByName(more)
    typed = both.withColumns({"type": F.split_part("name", F.lit("_"), F.lit(1)), "function": F.regexp_replace("name", "^[^_]*_?", "")})
    return typed.where(F.col("type").isin(*types))


def merge_reactions(groups: DataFrame, reactions: DataFrame) -> DataFrame:
    """``group_id, substrate, product`` that all profiles of a group have (``group_id, profile``; ``profile, substrate, product``, a table of rules, broadcast)."""
    return _held_by_all(groups, reactions, "group_id", "profile")


def group_prediction(hits: DataFrame) -> DataFrame:
    """Per overlap group its span and main type, ``ambiguous`` where there are several."""
    grouped = hits.groupBy(*GENE, "overlap_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("type").alias("n"), F.first("type").alias("type"))
    return grouped.withColumn("type", F.when(F.col("n") > 1, "ambiguous").otherwise(F.col("type"))).drop("n")


def area_products(predictions: DataFrame, priority: DataFrame) -> DataFrame:
    """``area_id, product``: products of an area's type with the best (lowest) priority (``type, priority``)."""
    ranked = predictions.join(F.broadcast(priority), "type").withColumn("best", F.min("priority").over(Window.partitionBy("area_id")))
    return ranked.where("priority = best").select("area_id", "product").distinct()


def resolve_function(annotations: DataFrame, tool: str) -> DataFrame:
    """``record_id, gene_id, function`` from (``tool, function``): core, else the named tool's single value, else what all agree on, else other."""
    mine = (F.col("tool") == tool) & (F.col("function") != "other")
    seen = annotations.groupBy(*GENE).agg(
        F.max((F.col("function") == "core").cast("int")).alias("core"), F.min(F.when(mine, F.col("function"))).alias("named"), F.countDistinct("function").alias("n"), F.min("function").alias("single")
    )
    return seen.select(*GENE, F.when(F.col("core") == 1, "core").when(F.col("named").isNotNull(), F.col("named")).when(F.col("n") == 1, F.col("single")).otherwise("other").alias("function"))


def tailoring_table(members: DataFrame, tools: Sequence[DataFrame]) -> DataFrame:
    """Per region and gene the (tool, function) hits of every tool."""
    every = tools[0]
    for tool in tools[1:]:
        every = every.unionByName(tool)
    return members.join(every, GENE).groupBy("region", *GENE).agg(F.sort_array(F.collect_set(F.struct("tool", "function"))).alias("hits"))


def gene_overview(annotations: DataFrame) -> DataFrame:
    """Per gene its functions, tools and descriptions."""
    rows = annotations.groupBy(*GENE).agg(F.sort_array(F.collect_set("function")).alias("functions"), F.sort_array(F.collect_set("tool")).alias("tools"), F.sort_array(F.collect_list("description")).alias("descriptions"))
    return rows.select(*GENE, *[F.array_join(c, ",").alias(c) for c in ("functions", "tools", "descriptions")])


def stage_totals(timings: DataFrame) -> DataFrame:
    """Seconds per stage over all records."""
    return timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"))


def promoters(genes: DataFrame, upstream: int = 1000, downstream: int = 50) -> DataFrame:
    """``record_id, gene_id, other_id, start, end`` of the window before each gene, cut at its neighbours' ends and kept inside the gene.

    A reverse gene and the forward one behind it whose windows meet share one window, from inside the one to inside the other; ``other_id`` is that second gene.
    """
    near = with_adjacent(genes, ["record_id"], ["start", "end", "gene_id"], ["gene_id", "start", "end", "strand"])
    forward, after = F.col("strand") == 1, F.col("after")
    faces = F.coalesce((F.col("strand") == -1) & (after["strand"] == 1) & (F.col("end") + upstream >= after["start"] - upstream), F.lit(False))
    faced = F.coalesce(forward & (F.col("before.strand") == -1) & (F.col("before.end") + upstream >= F.col("start") - upstream), F.lit(False))
    low = F.when(forward, F.greatest(F.col("start") - upstream, F.coalesce("before.end", F.lit(0)))).otherwise(F.greatest(F.col("end") - downstream, F.col("start")))
    alone = F.when(forward, F.least(F.col("start") + downstream, F.col("end"))).otherwise(F.least(F.col("end") + upstream, F.coalesce(after["start"], F.col("end") + upstream)))
    high = F.when(faces, F.least(after["start"] + downstream, after["end"])).otherwise(alone)
    rows = near.where(~faced).select("record_id", "gene_id", F.when(faces, after["gene_id"]).alias("other_id"), low.alias("start"), high.alias("end"))
    return rows.where("start < end")


def promoter_sequences(windows: DataFrame, sequences: DataFrame, least: int = 6, most: int = 2101) -> DataFrame:
    """Windows (``record_id, start, end``) with their ``promoter``, cut at the record's end, that is within the lengths and has each of A, C, G and T."""
    joined = windows.join(sequences.select("record_id", "seq"), "record_id")
    found = joined.withColumn("promoter", F.upper(F.substr("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))).drop("seq")
    size = F.length("promoter")
    return found.where(size.between(least, most) & F.col("promoter").contains("A") & F.col("promoter").contains("C") & F.col("promoter").contains("G") & F.col("promoter").contains("T"))


def promoter_sets(anchors: DataFrame, counts: DataFrame, reach: int = 15, least: int = 4) -> DataFrame:
    """``record_id, anchor, first, last``: windows of m before and p after an anchor's place (m + p >= 3), cut at the ends, distinct, with at least ``least`` promoters."""
    # A first and a last place stand for all m and p that are cut to them, the largest of which decide, so nothing is made distinct but the anchors.
    placed = anchors.select("record_id", "anchor").distinct().join(counts.select("record_id", "n"), "record_id")
    anchor, n, first, last = F.col("anchor"), F.col("n"), F.col("first"), F.col("last")
    one = F.lit(1).cast(counts.schema["n"].dataType)
    firsts = placed.withColumn("first", F.explode(F.sequence(F.greatest(one, anchor - reach), F.greatest(one, anchor))))
    spread = firsts.withColumn("last", F.explode(F.sequence(F.least(n, anchor), F.least(n, anchor + reach))))
    m, p = F.when(first == 1, reach).otherwise(anchor - first), F.when(last == n, reach).otherwise(last - anchor)
    return spread.where((m + p >= 3) & (last - first + 1 >= least)).select("record_id", "anchor", "first", "last")


def filter_motifs(hits: DataFrame, totals: DataFrame, most: float = 14.0) -> DataFrame:
    """``record_id, motif, percent`` of motifs that hit between 0 and ``most`` per cent of a record's promoters, the anchor's among them."""
    found = hits.groupBy("record_id", "motif").agg(F.countDistinct("promoter").alias("k"), F.max(F.col("is_anchor").cast("int")).alias("anchored"))
    share = found.join(totals, "record_id").withColumn("percent", 100.0 * F.col("k") / F.col("n"))
    return share.where((F.col("percent") > 0) & (F.col("percent") <= most) & (F.col("anchored") == 1)).select("record_id", "motif", "percent")


def motif_islands(hits: DataFrame, anchors: DataFrame, max_gap: int = 2) -> DataFrame:
    """``record_id, motif, anchor, first, last``: promoters with hits that reach the anchor over gaps of at most ``max_gap`` promoters."""
    placed = hits.select("record_id", "motif", F.col("promoter").alias("start"), (F.col("promoter") + 1).alias("end")).distinct()
    grouped = islands(placed, ["record_id", "motif"], gap=max_gap, strict=False)
    spans = grouped.groupBy("record_id", "motif", "island").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    return spans.join(anchors, "record_id").where((F.col("first") <= F.col("anchor")) & (F.col("anchor") <= F.col("last"))).select("record_id", "motif", "anchor", "first", "last")


def border_predictions(found: DataFrame) -> DataFrame:
    """Per anchor all pairs of a start and an end border with their abundance and best score, ranked."""
    side = lambda column, name: found.groupBy("record_id", "anchor", F.col(column).alias(name)).agg(F.count("*").alias(f"{name}_n"), F.min("score").alias(f"{name}_s"))
    pairs = side("first", "low").join(side("last", "high"), ["record_id", "anchor"])
    scored = pairs.select("record_id", "anchor", "low", "high", (F.col("low_n") + F.col("high_n")).alias("abundance"), F.least("low_s", "high_s").alias("score"))
    w = Window.partitionBy("record_id", "anchor").orderBy(F.desc("abundance"), "score", "low", "high")
    return scored.withColumn("rank", F.row_number().over(w))


def check_predictions(ranked: DataFrame, counts: DataFrame, least: int = 3, edge: int = 10) -> DataFrame:
    """Predictions up to and with the first sane one: at least ``least`` genes, and ``edge`` genes away from the record's ends."""
    sane = (F.col("high") - F.col("low") + 1 >= least) & (F.col("low") > edge) & (F.col("high") <= F.col("n") - edge)
    marked = ranked.join(counts, "record_id").withColumn("sane", sane)
    first = F.min(F.when(F.col("sane"), F.col("rank"))).over(Window.partitionBy("record_id", "anchor"))
    return marked.withColumn("_first", first).where("_first is null or rank <= _first").drop("_first", "n")


def number_domains(domains: DataFrame) -> DataFrame:
    """Add ``number``: the place of a domain among those of its name in the gene."""
    return domains.withColumn("number", F.row_number().over(Window.partitionBy(*GENE, "profile").orderBy("start", "end", "ord")))


def classify_domains(domains: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the ``class`` of each domain's profile; an unknown profile is an error."""
    joined = domains.join(F.broadcast(classes), "profile", "left")
    return joined.where(F.assert_true(F.col("class").isNotNull(), F.concat(F.lit("no class for "), F.col("profile"))).isNull())


def dominant_subtype(domains: DataFrame, default: str = "mixed") -> DataFrame:
    """``record_id, gene_id, subtype``: the strictly commonest subtype of a gene."""
    counted = domains.groupBy(*GENE, "subtype").agg(F.count("*").alias("n"))
    best = counted.groupBy(*GENE).agg(F.max("n").alias("n"))
    top = counted.join(best, [*GENE, "n"]).groupBy(*GENE).agg(F.count("*").alias("k"), F.min("subtype").alias("subtype"))
    return top.select(*GENE, F.when(F.col("k") == 1, F.col("subtype")).otherwise(default).alias("subtype"))


def consensus(predictions: DataFrame, allowed: Sequence[str], default: str) -> DataFrame:
    """``record_id, gene_id, call``: the commonest allowed prediction; a tie or none gives the default."""
    votes = predictions.where(F.col("call").isin(*allowed)).groupBy(*GENE, "call").agg(F.count("*").alias("n"))
    ranked = votes.groupBy(*GENE).agg(F.max("n").alias("n")).join(votes, [*GENE, "n"]).groupBy(*GENE).agg(F.count("*").alias("k"), F.min("call").alias("call"))
    genes = predictions.select(*GENE).distinct()
    return genes.join(ranked, GENE, "left").select(*GENE, F.when(F.col("k") == 1, F.col("call")).otherwise(default).alias("call"))


def rank_profiles(scores: DataFrame) -> DataFrame:
    """Add ``rank`` per gene: higher scores first, then names."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*GENE).orderBy(F.desc("score"), "profile", "ord")))


def colinear_order(genes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Add ``place``: genes along the strand that most of them are on, ties forward."""
    area = Window.partitionBy(*keys)
    directed = genes.withColumn("_direction", F.sum("strand").over(area))
    key = F.when(F.col("_direction") < 0, -F.col("start")).otherwise(F.col("start"))
    return directed.withColumn("_key", key).withColumn("place", F.row_number().over(area.orderBy("_key", "gene_id"))).drop("_direction", "_key")


def colinear_places(genes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """As ``colinear_order``, with places counted over range partitions, for records of any size."""
    sides = genes.groupBy(*keys).agg(F.sum("strand").alias("_direction"))
    keyed = genes.join(sides, list(keys)).withColumn("_key", F.when(F.col("_direction") < 0, -F.col("start")).otherwise(F.col("start")))
    counted = prefix_totals(keyed, keys, ["_key", "gene_id"], rows="_before")
    return counted.withColumn("place", (F.col("_before") + 1).cast("int")).drop("_direction", "_key", "_before")


def polymer(modules: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """``polymer`` per area: monomers of a gene joined by `` - `` in brackets, genes by `` + `` in order of ``place``."""
    rows = polymer_rows(modules, keys).select(*keys, F.struct("place", "text").alias("g")).groupBy(*keys).agg(F.sort_array(F.collect_list("g")).alias("g"))
    return rows.select(*keys, F.array_join(F.transform("g", lambda x: x["text"]), " + ").alias("polymer"))


def polymer_rows(modules: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """``place, text`` per gene: the parts of ``polymer`` as ordered rows, so that a long area is no single string or group."""
    genes = modules.groupBy(*keys, "place").agg(F.sort_array(F.collect_list(F.struct("number", "monomer"))).alias("m"))
    return genes.select(*keys, "place", F.concat(F.lit("("), F.array_join(F.transform("m", lambda x: x["monomer"]), " - "), F.lit(")")).alias("text"))


def count_enzyme_kinds(modules: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Per area the genes with complete modules of only the first kind, only the second, and both (``kind`` ``pks`` or ``nrps``)."""
    genes = modules.where("complete").groupBy(*keys, "gene_id").agg(F.max((F.col("kind") == "pks").cast("int")).alias("p"), F.max((F.col("kind") == "nrps").cast("int")).alias("n"))
    return genes.groupBy(*keys).agg(F.sum(F.when(F.col("n") == 0, F.col("p")).otherwise(0)).alias("pks"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("nrps"), F.sum(F.col("p") * F.col("n")).alias("hybrid"))


def domain_sequences(domains: DataFrame, genes: DataFrame, types: Sequence[str]) -> DataFrame:
    """``record_id, gene_id, ord, seq``: the gene's ``translation`` under each domain of the types."""
    chosen = domains.where(F.col("profile").isin(*types)).join(genes.select(*GENE, "translation"), GENE)
    return chosen.select(*GENE, "ord", F.substr("translation", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"))

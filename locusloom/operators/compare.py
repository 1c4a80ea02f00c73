"""Comparison of areas with reference areas: scores and rankings.

Alignments have ``region, query_id, query_idx, ref_area, ref_gene, ref_idx, identity, coverage, score, ord``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import components, greedy_pairs

PAIR = ["region", "ref_area"]
#: Each metric's floor, and the most references that a ranking keeps.
FLOOR, KEEP = 0.05, 50


def threshold_hits(alignments: DataFrame, min_coverage: float, min_identity: float, inclusive: bool = False) -> DataFrame:
    """Alignments over both bounds. Exclusive bounds compare an identity that is rounded half up."""
    if inclusive:
        return alignments.where((F.col("identity") >= min_identity) & (F.col("coverage") >= min_coverage))
    return alignments.where((F.floor(F.col("identity") + 0.5) > min_identity) & (F.col("coverage") > min_coverage))


def score_references(alignments: DataFrame, core_genes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per region and reference: queries with hits, subjects, core-gene hits, summed score, similarity in per cent.

    ``core_genes`` has ``query_id``; ``sizes`` has ``ref_area, n_genes``.
    """
    core = core_genes.select("query_id").distinct().withColumn("_core", F.lit(True))
    rows = alignments.join(core, "query_id", "left")
    counted = rows.groupBy(*PAIR).agg(
        F.countDistinct("query_id").alias("hits"), F.countDistinct("ref_gene").alias("subjects"), F.countDistinct(F.when(F.col("_core"), F.col("query_id"))).alias("core_hits"), F.sum("score").alias("score")
    )
    return counted.join(sizes, "ref_area").withColumn("similarity", F.floor(100 * F.col("subjects") / F.col("n_genes")))


def synteny(pairs: DataFrame) -> DataFrame:
    """``synteny`` per region and reference, over distinct pairs (``query_idx, ref_idx, core, place``) in their order.

    A pair and the next one count where their steps on both sides are equal and below 2; one more with a core gene; every query and
    subject counts once, and none that the next query also hits.
    """
    w = Window.partitionBy(*PAIR).orderBy("place")
    stepped = pairs.withColumns({"next_query": F.lead("query_idx").over(w), "next_ref": F.lead("ref_idx").over(w), "next_core": F.lead("core").over(w)}).where("next_query is not null")
    step = F.abs(F.col("query_idx") - F.col("next_query"))
    alike = (step < 2) & (step == F.abs(F.col("ref_idx") - F.col("next_ref")))
    hit_next = pairs.select(*PAIR, F.col("query_idx").alias("next_query"), "ref_idx").distinct()
    able = stepped.where(alike).join(hit_next, [*PAIR, "next_query", "ref_idx"], "left_anti")
    able = able.withColumn("worth", F.lit(1) + (F.col("core") | F.col("next_core")).cast("int"))
    return greedy_pairs(able, PAIR, "query_idx", "ref_idx", "place").groupBy(*PAIR).agg(F.sum("worth").alias("synteny"))


def rank_references(stats: DataFrame, n: int = KEEP) -> DataFrame:
    """Add ``total``, ``rank`` and the number of references before the cut; the best ``n`` of each region stay.

    ``stats`` has ``hits, core_hits, subjects, synteny, score, n_genes``. Two hits on two subjects are needed, but for references of one gene.
    """
    able = stats.where("hits >= 1 and (n_genes = 1 or (hits >= 2 and subjects >= 2))")
    total = F.col("hits") + F.col("core_hits") + F.coalesce("synteny", F.lit(0)) + F.when(F.col("core_hits") > 0, 3).otherwise(0)
    w = Window.partitionBy("region").orderBy(F.desc("total"), F.desc("score"), "ref_area")
    ranked = able.withColumn("total", total).withColumns({"rank": F.row_number().over(w), "n_references": F.count("*").over(Window.partitionBy("region"))})
    return ranked.where(F.col("rank") <= n)


def homology_table(alignments: DataFrame) -> DataFrame:
    """Per region and query its subjects (``ref_name`` like ``x_c7``) in order, and their cluster numbers."""
    numbered = alignments.withColumn("cluster", F.regexp_extract("ref_name", r"_c(\d+)", 1).cast("int"))
    rows = numbered.groupBy("region", "query_id").agg(F.sort_array(F.collect_set(F.struct("ref_name", "cluster"))).alias("subjects"))
    return rows.select("region", "query_id", F.transform("subjects", lambda s: s["ref_name"]).alias("names"), F.transform("subjects", lambda s: s["cluster"]).alias("clusters"))


def linked_groups(alignments: DataFrame) -> DataFrame:
    """``region, query_id, group_id``: queries of a region that shared subjects connect; the group is its smallest query.

    Node ids are made of region and gene, so all regions go through one run of components. Subjects come after all queries of
    their region, so a component's smallest node is its smallest query, and nothing is gathered by component.
    """
    base = F.col("region") * (1 << 40)
    query, subject = base + F.col("query_id"), base + (1 << 39) + F.col("ref_gene")
    found = components(alignments.select(query.alias("a"), subject.alias("b")))
    queries = alignments.select("region", "query_id", query.alias("node")).distinct().join(found, "node")
    return queries.select("region", "query_id", (F.col("component") - base).alias("group_id"))


def genes_of_interest(ranking: DataFrame, references: DataFrame) -> DataFrame:
    """Distinct genes (``ref_gene``) of the ranked references."""
    return references.join(ranking.select("ref_area").distinct(), "ref_area", "left_semi").select("ref_gene").distinct()


def identity_score(pairs: DataFrame) -> DataFrame:
    """Mean identity per pair of areas, through a logit from (-6, 6) to (0, 1)."""
    mean = F.avg("identity") / 100
    scored = pairs.groupBy(*PAIR).agg(mean.alias("m"))
    logit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ln(F.col("m") / (1 - F.col("m"))) / 12 + 0.5))
    return scored.select(*PAIR, F.when(F.col("m") > 1 - 1e-8, 1.0).when(F.col("m") < 1e-8, 0.0).otherwise(logit).alias("identity_score"))


def order_score(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """How far linked genes keep their order: ``order_score`` per pair of areas.

    ``pairs`` has ``query_idx, ref_idx, same_strand`` with one reference per query; ``sizes`` has ``query_size, ref_size``.
    """
    w = Window.partitionBy(*PAIR).orderBy("query_idx", "ref_idx")
    lag = lambda c: F.lag(c).over(w)
    breaks = (lag("same_strand") != F.col("same_strand")) | (F.col("query_idx") != lag("query_idx") + 1) | (F.abs(F.col("ref_idx") - lag("ref_idx")) != 1)
    cut = pairs.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("query_idx", "ref_idx")
    segments = cut.groupBy(*PAIR, "segment").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.first("same_strand").alias("same_strand"))
    v = Window.partitionBy(*PAIR).orderBy("segment")
    before = segments.withColumns({"p_first": F.lag("first").over(v), "p_last": F.lag("last").over(v)}).join(sizes, PAIR)
    rising = F.col("p_first")["ref_idx"] < F.col("first")["ref_idx"]
    low = lambda a, b: F.least(F.col(a)["ref_idx"], F.col(b)["ref_idx"])
    high = lambda a, b: F.greatest(F.col(a)["ref_idx"], F.col(b)["ref_idx"])
    ref_gap = F.when(rising, low("first", "last") - high("p_first", "p_last")).otherwise(low("p_first", "p_last") - high("first", "last")) / F.col("ref_size")
    query_gap = (F.col("first")["query_idx"] - F.col("p_last")["query_idx"]) / F.col("query_size")
    factor = F.when(F.col("p_first").isNull(), 1.0).otherwise(0.5 + 0.5 * (1 - F.greatest(query_gap, ref_gap)))
    rolled = before.withColumn("factor", factor).groupBy(*PAIR, "query_size", "ref_size").agg(
        F.sum("n").alias("hits"), F.count("*").alias("segments"), F.sum((~F.col("same_strand")).cast("int")).alias("reversed"), F.sort_array(F.collect_list(F.struct("segment", "factor"))).alias("factors")
    )
    most = F.least("query_size", "ref_size")
    base = F.pow(F.lit(1 / 0.8), 1 / (F.lit(1 - 0.8) * most))
    product = F.aggregate("factors", F.lit(1.0), lambda a, x: a * x["factor"])
    flips = F.least(F.col("reversed"), F.col("segments") - F.col("reversed"))
    single = F.when((F.col("hits") == 1) & (F.col("ref_size") > 1), 0.75).otherwise(1.0)
    return rolled.select(*PAIR, (F.pow(base, F.col("hits") - most) * product * F.pow(F.lit(0.9), flips) * single).alias("order_score"))


def components_of(genes: DataFrame, keys: list[str]) -> DataFrame:
    """Multisets of areas: counts per kind and value; ``genes`` has ``kind, value``; functions of ``other`` do not count."""
    return genes.where("not (kind = 'function' and value = 'other')").groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))


def component_score(query: DataFrame, reference: DataFrame, mode: str = "reference_in_query", corrected: bool = False) -> DataFrame:
    """``region, ref_area, kind, component_score``: shared counts over the size of the side that the mode names.

    Modes are ``reference_in_query``, ``query_in_reference`` and ``best``; ``best`` divides by the query's size, or by the smaller one
    if ``corrected``. Only pairs with something of the kind on both sides have a row.
    """
    sizes = lambda df, key, name: df.groupBy(key, "kind").agg(F.sum("n").alias(name))
    q, r = sizes(query, "region", "q"), sizes(reference, "ref_area", "r")
    shared = query.join(reference.withColumnRenamed("n", "m"), ["kind", "value"]).groupBy("region", "ref_area", "kind").agg(F.sum(F.least("n", "m")).alias("shared"))
    most = F.col("r") if mode == "reference_in_query" else F.least("q", "r") if mode == "best" and corrected else F.col("q")
    return shared.join(q, ["region", "kind"]).join(r, ["ref_area", "kind"]).select("region", "ref_area", "kind", (F.col("shared") / most).alias("component_score"))


def module_tuples(domains: DataFrame, properties: DataFrame) -> DataFrame:
    """``record_id, gene_id, kind, value`` of complete modules: the names of their domains in order, subtypes of condensation domains cut off.

    ``domains`` have ``module`` (``segment_modules``), ``properties`` ``kind`` and ``complete`` (``module_properties``); modules of neither kind are ``generic``.
    """
    keys = ["record_id", "gene_id", "module"]
    name = F.regexp_replace("profile", "^Condensation_.*", "Condensation")
    tuples = domains.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "ord", name.alias("name")))).alias("parts"))
    kind = F.when(F.col("kind").isin("nrps", "pks"), F.col("kind")).otherwise("generic")
    return tuples.join(properties.where("complete").select(*keys, "kind"), keys).select("record_id", "gene_id", kind.alias("kind"), F.array_join(F.col("parts.name"), "|").alias("value"))


#: Kinds of components: modules, then profiles and functions.
MODULES, KINDS = ("nrps", "pks", "generic"), ("nrps", "pks", "generic", "profile", "function")


def met_components(pairs: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """Each of ``pairs`` with the sizes of both sides by kind (``q_`` and ``r_``) and what they share of it (``s_``)."""

    def packed(df: DataFrame, key: str, side: str) -> DataFrame:
        sizes = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{side}_{k}") for k in KINDS]
        return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "value"), "n"))).alias(f"{side}_parts"), *sizes)

    met = pairs.select("region", "ref_area").join(packed(query, "region", "q"), "region", "left").join(packed(reference, "ref_area", "r"), "ref_area", "left")
    met = met.fillna(0, [f"{side}_{k}" for side in "qr" for k in KINDS])
    shared = F.transform(F.map_entries("q_parts"), lambda e: F.struct(e["key"]["kind"].alias("kind"), F.least(e["value"], F.coalesce(F.try_element_at("r_parts", e["key"]), F.lit(0))).alias("n")))
    met = met.withColumn("shared", F.when(F.col("r_parts").isNotNull(), F.coalesce(shared, F.array().cast("array<struct<kind:string,n:bigint>>"))))
    of_kind = lambda kind: F.aggregate(F.filter("shared", lambda e: e["kind"] == kind), F.lit(0).cast("long"), lambda total, e: total + e["n"])
    sizes = [f"{side}_{k}" for side in "qr" for k in KINDS]
    return met.select("region", "ref_area", *sizes, *[F.when(F.col(f"q_{k}") * F.col(f"r_{k}") > 0, of_kind(k)).alias(f"s_{k}") for k in KINDS])


def _similarity(mode: str, corrected: bool) -> Column:
    """``modules, profiles, functions, component_score`` of rows of ``met_components``."""
    one_way, other_way = mode == "reference_in_query", mode == "query_in_reference"

    def share(kind: str) -> Column:
        q, r = F.col(f"q_{kind}"), F.col(f"r_{kind}")
        most = r if one_way else F.least(q, r) if mode == "best" and corrected else q
        return F.when(r == 0, 0.0 if other_way else 1.0).when(q == 0, 0.0 if one_way else 1.0).otherwise(F.col(f"s_{kind}") / most)

    total = lambda side: F.col(f"{side}_nrps") + F.col(f"{side}_pks") + F.col(f"{side}_generic")
    most = total("r") if one_way else total("q") if other_way else F.least(total("q"), total("r"))
    weight = lambda k: (F.col(f"r_{k}") if one_way else F.col(f"q_{k}") if other_way else F.least(f"q_{k}", f"r_{k}")) / most
    modules = F.when(most > 0, share("nrps") * weight("nrps") + share("pks") * weight("pks") + share("generic") * weight("generic"))
    profiles, functions = share("profile"), share("function")
    score = F.when(modules.isNull(), (profiles + functions) / 2).otherwise((modules + profiles + functions) / 3)
    telling = F.col("r_nrps") + F.col("r_pks") + F.col("r_profile") > 0
    return F.struct(modules.alias("modules"), profiles.alias("profiles"), functions.alias("functions"), (score if other_way else F.when(telling, score)).alias("component_score"))


def similarity_by_modes(pairs: DataFrame, query: DataFrame, reference: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``component_similarity`` in several modes, with ``mode``: the sides meet once."""
    each = F.array(*[F.struct(F.lit(m).alias("mode"), _similarity(m, False).alias("found")) for m in modes])
    return met_components(pairs, query, reference).select("region", "ref_area", F.inline(each)).select("region", "ref_area", "mode", "found.*")


def component_similarity(pairs: DataFrame, query: DataFrame, reference: DataFrame, mode: str = "best", corrected: bool = False) -> DataFrame:
    """``region, ref_area, modules, profiles, functions, component_score`` for each of ``pairs`` (``region, ref_area``), also where a side is empty.

    Both sides' multisets (``components_of`` with all of ``KINDS``) are packed into one row per area and met in the pair's row, so only given pairs are
    compared. A kind's share is the shared count over the side that the mode names; an empty reference counts 1, or 0 in
    ``query_in_reference``, else an empty query counts 1, or 0 in ``reference_in_query``. Module kinds are weighted by how
    many modules of them there are; without modules the score is the mean of profiles and functions, else of all three. A reference without modules of
    the first two kinds and without profiles has no score but in ``query_in_reference``. ``best`` divides as ``component_score`` does.
    """
    return met_components(pairs, query, reference).select("region", "ref_area", _similarity(mode, corrected).alias("found")).select("region", "ref_area", "found.*")


def final_score(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Add ``final``: the geometric mean of the metrics there are; a pair with one below the floor goes."""
    present = F.filter(F.array(*names), lambda m: m.isNotNull())
    kept = metrics.where(~F.exists(present, lambda m: m < FLOOR) & (F.size(present) > 0))
    product = F.aggregate(present, F.lit(1.0), lambda a, m: a * m)
    return kept.withColumn("final", F.pow(product, 1 / F.size(present)))


def rank_region_region(scores: DataFrame, n: int = KEEP) -> DataFrame:
    """The best ``n`` references of each region by ``final``."""
    w = Window.partitionBy("region").orderBy(F.desc("final"), "ref_area")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_area_region(scores: DataFrame, n: int = KEEP) -> DataFrame:
    """``region, ref_area, total, rank`` from scores of a region's areas (``area``): the sum of (e^3s - 1) / (e^3 - 1), or the score itself of a single area."""
    areas = scores.groupBy("region").agg(F.countDistinct("area").alias("n_areas"))
    curved = (F.exp(3 * F.col("final")) - 1) / (F.exp(F.lit(3.0)) - 1)
    summed = scores.join(areas, "region").groupBy("region", "ref_area").agg(F.sum(F.when(F.col("n_areas") == 1, F.col("final")).otherwise(curved)).alias("total"))
    w = Window.partitionBy("region").orderBy(F.desc(F.round("total", 9)), "ref_area")
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_area_area(scores: DataFrame, n: int = KEEP) -> DataFrame:
    """As ``rank_area_region``, from the best score of each area with any area (``ref_part``) of the reference."""
    return rank_area_region(scores.groupBy("region", "area", "ref_area").agg(F.max("final").alias("final")), n)


def limit_details(details: DataFrame, ranking: DataFrame) -> DataFrame:
    """Details of ranked references only."""
    return details.join(ranking.select(*PAIR), PAIR, "left_semi")


def core_similarity(core_hits: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Add ``similarity``: identical residues over the longer length; those above the threshold stay."""
    return core_hits.withColumn("similarity", F.col("n_identical") / F.greatest("query_length", "ref_length")).where(F.col("similarity") > threshold)


#: Residues, and the residues that count as similar to each.
SIMILAR = {
    "A": "S", "D": "NE", "E": "QDK", "F": "YW", "H": "YN", "I": "VLM", "K": "RQE", "L": "MIV", "M": "LIV",
    "N": "DHS", "Q": "ERK", "R": "KQ", "S": "ANT", "T": "S", "V": "IML", "W": "YF", "Y": "FHW",
}


_ALIKE = np.zeros((128, 128), bool)
for _a, _others in SIMILAR.items():
    for _b in _others:
        _ALIKE[ord(_a), ord(_b)] = True

#: Letters that are compared at once; a longer pair is compared alone.
_AT_ONCE = 1 << 20


def _marked(queries: list[str], references: list[str]) -> list[str]:
    """The marks of pairs of equally long texts, over all their letters at once."""
    a, b = (np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4") for some in (queries, references))
    alike = (a < 128) & (b < 128)
    alike[alike] = _ALIKE[a[alike], b[alike]]
    marks = np.where(a == b, a, np.where(alike, ord("+"), ord(" "))).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum([len(q) for q in queries]).tolist()
    return [marks[low:high] for low, high in zip([0, *ends[:-1]], ends, strict=True)]


def _consensus(query: pa.Array, reference: pa.Array) -> pa.Array:
    """Of a null and a text the result is null, but empty where nothing is to be compared."""
    out: list[str | None] = []
    queries, references, places, letters = [], [], [], 0

    def flush() -> None:
        for place, text in zip(places, _marked(queries, references) if places else [], strict=True):
            out[place] = text

    for q, r in zip(query.to_pylist(), reference.to_pylist(), strict=True):
        out.append("" if not q and not r or q == "" or r == "" else None)
        if q and r:
            n = min(len(q), len(r))
            queries.append(q[:n]), references.append(r[:n]), places.append(len(out) - 1)
            letters += n
            if letters >= _AT_ONCE:
                flush()
                queries, references, places, letters = [], [], [], 0
    flush()
    return pa.array(out, pa.string())


_consensus_udf = F.arrow_udf(_consensus, T.StringType()).asNondeterministic()


def consensus_string(query: Column, reference: Column) -> Column:
    """The residue where both agree, ``+`` where they are similar, a space elsewhere. The letters of an Arrow batch are compared at once."""
    return _consensus_udf(query, reference)


def group_references(core_hits: DataFrame) -> DataFrame:
    """Per query and reference sequence the best hit, and how many others share it."""
    same = Window.partitionBy("query_id", "ref_seq")
    ranked = core_hits.withColumns({"_n": F.row_number().over(same.orderBy(F.desc("similarity"), "ref_name")), "n_others": F.count("*").over(same) - 1})
    return ranked.where("_n = 1").drop("_n")

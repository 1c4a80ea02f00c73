"""Residues at sites and motifs, the best of several hits, precursors near their enzymes, and detectors around anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import range_join

GENE = ["record_id", "gene_id"]


def residues_at(query: Column, reference: Column, positions: Column, gap: str = ".") -> Column:
    """The query's characters at 1-based positions (an array) of the reference without its gaps; null where the reference is too short.

    Only so much is split as the last position can need: that many characters and all of the reference's gaps.
    """
    needed = F.greatest(F.array_max(positions), F.lit(0)) + F.length(reference) - F.length(F.replace(reference, F.lit(gap), F.lit("")))
    letters = lambda text: F.split(F.left(text, needed), "")
    pair = F.array(F.struct(letters(query).alias("query"), letters(reference).alias("reference"), positions.alias("positions")))

    def picked(p: Column) -> Column:
        columns = F.filter(F.sequence(F.lit(1), F.least(F.size(p["query"]), F.size(p["reference"]))), lambda k: F.element_at(p["reference"], k) != gap)
        inside = (F.array_max(p["positions"]) <= F.size(columns)) & (F.array_min(p["positions"]) >= 1)
        return F.when(inside, F.array_join(F.transform(p["positions"], lambda x: F.element_at(p["query"], F.element_at(columns, x))), ""))

    return F.when(F.size(positions) == 0, "").when((F.length(query) > 0) & (F.length(reference) > 0), F.element_at(F.transform(pair, picked), 1))


def active_sites(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """``domain_id, site, residues, label`` of aligned domains (``domain_id, profile, query, reference, hit_start``).

    ``sites`` (``site, profile, scaffold, expected, target, labels, other``) has a row per check: the scaffold's positions, counted in the alignment,
    have to hold the expected residues (none asked for: always); the target's positions, counted in the profile, give the label by a map of residues, or ``other``. A check without
    label or that lies outside the alignment gives no row. The site table is of code size; Spark broadcasts it while it is small.
    """
    joined = alignments.join(sites, "profile")
    here = F.transform("target", lambda p: p - F.col("hit_start"))
    found = joined.withColumns({"_scaffold": residues_at(F.col("query"), F.col("reference"), F.col("scaffold")), "residues": residues_at(F.col("query"), F.col("reference"), here)})
    label = F.coalesce(F.try_element_at("labels", F.col("residues")), F.col("other"))
    return found.where((F.col("_scaffold") == F.col("expected")) & F.col("residues").isNotNull()).select("domain_id", "site", "residues", label.alias("label")).where("label is not null")


#: Site, database of the alignment, scaffold positions and residues, target positions, labels by residues, the label of others, and
#: the label where the scaffold does not match (null: the scaffold is not needed). ``{scaffold}`` stands for whether it matches.
CHECKS = (
    ("asp_ks", "PKSI-KS_N", (176, 186, 187, 188), "GSSS", (185,), {"C": "found active site cysteine: True, scaffold matched GSSS: {scaffold}"}, "found active site cysteine: False, scaffold matched GSSS: {scaffold}", None),
    ("asp_ks_c", "PKSI-KS_C", (47, 50, 51, 52, 53, 56, 57, 60, 106, 110, 117, 123), "EGTGTGDEKGGK", (49, 111), {"HH": "found active site histidines: True"}, "found active site histidines: False", None),
    ("asp_at", "PKSI-AT", (93, 94, 97, 98), "GHGE", (95,), {"S": "found active site serine: True, scaffold matched GHGE: {scaffold}"}, "found active site serine: False, scaffold matched GHGE: {scaffold}", None),
    ("acp_type", "PKSI-ACP", (28, 30, 31), "GDS", (37,), {"W": "beta-branching ACP"}, "non-beta-branching ACP", None),
    ("asp_acp", "PKSI-ACP", (28, 30), "GD", (31,), {"S": "found active site serine: True"}, "found active site serine: False", None),
    ("asp_pksi_dh", "PKSI-DH", (4, 5, 6, 30, 32, 34), "LLGPLD", (5, 39, 44), {"HGP": "catalytic triad H,G,P found: True"}, "catalytic triad H,G,P found: False", "catalytic triad H,G,P inconclusive"),
    ("asp_pksi_kr", "PKSI-KR", (33, 65, 92, 97, 120, 148), "RDGAKS", (149, 162, 166), {"SYN": "catalytic triad S,Y,N found: True"}, "catalytic triad S,Y,N found: False", "catalytic triad S,Y,N inconclusive"),
    ("asp_thioesterase", "Thioesterase", (73, 79, 83, 87, 108), "GGGAD", (81,), {"S": "active site serine present: True"}, "active site serine present: False", "active site serine inconclusive"),
    ("pksi_er_stereo", "PKSI-ER", (31, 135, 137, 144, 146, 227), "DLHGAG", (39,), {"Y": "ER domain putatively catalyzing 2S-configuration product formation"}, "ER domain putatively catalyzing 2R-configuration product formation", "ER configuration inconclusive"),
    ("pksi_kr_stereo", "PKSI-KR", (149, 162, 166), "SYN", (102,), {"D": "KR domain putatively catalyzing D-configuration product formation"}, "KR domain putatively catalyzing L-configuration product formation", None),
    ("pksi_at_spec", "PKSI-AT", (93, 94, 95, 120, 196, 198, 199, 227, 244, 245), "GHSRAHSSYW", (195, 197), {"HF": "Malonyl-CoA specific", "YS": "Methylmalonyl-CoA specific"}, "Neither malonyl-CoA or methylmalonyl-CoA specific", "(Methyl)Malonyl-CoA specificity inconclusive"),
    ("asp_p450_oxy", "p450", (327, 330, 400, 403, 409), "ERFGG", (407,), {"C": "active site cysteine present: True"}, "active site cysteine present: False", "active site cysteine inconclusive"),
)
CHECK_TYPE = "site string, profile string, scaffold array<int>, expected string, target array<int>, labels map<string,string>, other string, failed string"


def residues_by_position(query: Column, reference: Column, gap: str = ".") -> Column:
    """The query's characters at the reference's columns without gaps: character p of it stands at position p of the aligned part of the profile."""
    return F.array_join(F.zip_with(F.split(query, ""), F.split(reference, ""), lambda q, r: F.when((r != gap) & (r != ""), q)), "")


def site_checks(alignments: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """``domain_id, site, residues, scaffold, label`` of aligned domains (``domain_id, profile, query, reference, hit_start``), one row per check of their profile.

    The map from profile positions to residues is made once per alignment and asked by all its checks. The scaffold is asked for by positions of the
    alignment, the target by those of the profile. Positions outside an alignment, null and empty ones give no residues, so neither scaffold nor labels match.
    ``checks`` has rows of ``CHECK_TYPE`` (default: ``CHECKS``); it is of code size.
    """
    if checks is None:
        rows = [(site, profile, list(scaffold), expected, list(target), labels, other, failed) for site, profile, scaffold, expected, target, labels, other, failed in CHECKS]
        checks = alignments.sparkSession.createDataFrame(rows, CHECK_TYPE)
    mapped = alignments.select("domain_id", "profile", "hit_start", residues_by_position(F.col("query"), F.col("reference")).alias("at"))

    def taken(positions: Column, shift: Column) -> Column:
        inside = (F.array_max(positions) - shift <= F.length("at")) & (F.array_min(positions) - shift >= 1)
        return F.when(inside, F.array_join(F.transform(positions, lambda p: F.substr("at", p - shift, F.lit(1))), "")).otherwise("")

    found = mapped.join(checks, "profile").select("domain_id", "site", "labels", "other", "failed", taken(F.col("target"), F.col("hit_start")).alias("residues"), (taken(F.col("scaffold"), F.lit(0)) == F.col("expected")).alias("scaffold"))
    label = F.when(~F.col("scaffold") & F.col("failed").isNotNull(), F.col("failed")).otherwise(F.coalesce(F.try_element_at("labels", F.col("residues")), F.col("other")))
    return found.select("domain_id", "site", "residues", "scaffold", F.replace(label, F.lit("{scaffold}"), F.when(F.col("scaffold"), "True").otherwise("False")).alias("label"))


def match_motifs(hits: DataFrame, found: DataFrame, motifs: DataFrame, profiles: DataFrame, confidence: float = 1.0) -> DataFrame:
    """``hit_id, motif, substrate, confidence`` of a hit's motifs (``found``: ``hit_id, motif, residues``) that are near enough to theirs.

    Where hits share an id, ``found`` is to have their ``profile`` too. Equal rows of it are one, so each hit has its own motifs once.
    ``motifs`` has ``profile, motif, pattern`` (``.``: any), ``least, most`` (bounds on differing places), ``preference, substrate``; ``profiles`` has ``profile, cutoffs`` (falling),
    ``step`` (a factor for each cutoff that the score misses) and ``penalty`` (taken for each motif after those of the best preference). Hits under the last
    cutoff have none; a profile without motifs gives one row with a null motif.
    """
    able = hits.join(profiles, "profile").where(F.col("score") >= F.element_at("cutoffs", -1))
    missed = F.size(F.filter("cutoffs", lambda c: F.col("score") < c))
    able = able.withColumn("_base", F.lit(confidence) * F.pow("step", missed))
    differing = F.aggregate(F.zip_with(F.split("residues", ""), F.split("pattern", ""), lambda a, b: (~F.coalesce((a == b) | (b == "."), F.lit(False))).cast("int")), F.lit(0), lambda n, x: n + x)
    distance = F.when(F.length("pattern") == 0, 0).otherwise(differing)
    own = ["hit_id", *(["profile"] if "profile" in found.columns else [])]
    near = able.join(found.distinct(), own).join(motifs, ["profile", "motif"]).withColumn("_distance", distance).where(F.col("_distance").between(F.col("least"), F.col("most")))
    w = Window.partitionBy("hit_id")
    ranked = near.withColumn("_best", F.min("preference").over(w)).withColumn("_later", F.sum((F.col("preference") > F.col("_best")).cast("int")).over(w.orderBy("preference", "motif").rowsBetween(Window.unboundedPreceding, 0)))
    rows = ranked.select("hit_id", "motif", "substrate", F.greatest(F.lit(0.0), F.col("_base") - F.col("_later") * F.col("penalty")).alias("confidence"))
    plain = able.join(motifs.select("profile").distinct(), "profile", "left_anti").select("hit_id", F.lit(None).cast("string").alias("motif"), F.lit(None).cast("string").alias("substrate"), F.col("_base").alias("confidence"))
    return rows.unionByName(plain)


def choose_hit(general: DataFrame, specific: DataFrame) -> DataFrame:
    """``record_id, gene_id, profile, is_specific``: the best general hit of a gene, or its one most confident specific hit.

    ``general`` has ``score, conventional, ord``, ``specific`` ``confidence, ord``. A specific hit counts where the best general hit (by score, then ``ord``) is
    conventional, and wins where no other is as confident.
    """
    best = general.groupBy(*GENE).agg(F.min_by(F.struct("profile", "conventional"), F.struct((-F.col("score")).alias("s"), F.col("ord"))).alias("g"))
    top = specific.groupBy(*GENE).agg(F.max("confidence").alias("confidence"))
    sure = specific.join(top, [*GENE, "confidence"]).groupBy(*GENE).agg(F.count("*").alias("n"), F.min_by("profile", "ord").alias("s"))
    joined = best.join(sure, GENE, "left")
    wins = F.coalesce(F.col("g.conventional") & (F.col("n") == 1), F.lit(False))
    return joined.select(*GENE, F.when(wins, F.col("s")).otherwise(F.col("g.profile")).alias("profile"), wins.alias("is_specific"))


def precursor_candidates(areas: DataFrame, genes: DataFrame, orfs: DataFrame, cores: DataFrame, bin_width: int, most: int = 120, distance: int = 10_000) -> DataFrame:
    """``record_id, area_id, core_id, gene_id`` of short genes and new frames of an area that overlap the surroundings of one of its core enzymes.

    ``genes`` have ``size`` (residues) and ``known`` (a precursor's profile was found); ``orfs`` have ``size``; ``cores`` are genes too. A gene is short under ``most``
    residues, with a known profile up to a quarter more; ``areas`` have ``record_id, area_id, start, end``.
    """
    span = ["record_id", "gene_id", "start", "end"]
    short = genes.where((F.col("size") < most) | (F.col("known") & (F.col("size") <= 1.25 * most))).select(*span)
    every = short.unionByName(orfs.where(F.col("size") < most).select(*span))
    inside = lambda rows, name: range_join(areas.select("record_id", "area_id", "start", "end"), rows, ["record_id"], bin_width, how="contain").select("record_id", F.col("l.area_id").alias("area_id"), F.col("r.gene_id").alias(name), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    wide = inside(cores.select(*span), "core_id").select("record_id", "area_id", "core_id", (F.col("start") - distance).alias("start"), (F.col("end") + distance).alias("end"))
    near = range_join(wide, inside(every, "gene_id"), ["record_id", "area_id"], max(bin_width, distance))
    return near.select("record_id", "area_id", F.col("l.core_id").alias("core_id"), F.col("r.gene_id").alias("gene_id"))


def fit_classifier(examples: DataFrame, features: Sequence[str], label: str = "label", ridge: float = 0.01) -> PipelineModel:
    """Scaled features and a linear support vector machine, fitted on the cluster."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LinearSVC(featuresCol="_scaled", labelCol=label, regParam=ridge, maxIter=50)]
    return Pipeline(stages=stages).fit(examples)


def classifier_score(rows: DataFrame, model: PipelineModel, points: int = 10) -> DataFrame:
    """Add ``score``: the points where the classifier says yes, else 0."""
    found = model.transform(rows).withColumn("score", (F.col("prediction") * points).cast("int"))
    return found.drop("_raw", "_scaled", "rawPrediction", "prediction")


def anchored_detector(genes: DataFrame, hits: DataFrame, orfs: DataFrame, both: Sequence[str], first: Sequence[str], second: Sequence[str], regex: str, distance: int, min_length: int, max_length: int = 0) -> DataFrame:
    """``record_id, gene_id`` of anchors with a matching gene or new frame within ``distance``.

    An anchor has a profile of ``both``, or one of ``first`` and one of ``second``. What matches lies (``translation``) whole in the anchor's surroundings, within the
    length bounds (0: no upper one).
    """
    has = lambda names: F.max(F.col("profile").isin(*names).cast("int")) == 1 if names else F.lit(False)
    anchors = hits.groupBy(*GENE).agg((has(both) | (has(first) & has(second))).alias("ok")).where("ok").select(*GENE)
    size = F.length("translation")
    able = genes.select(*GENE, "start", "end", "translation").unionByName(orfs.select(*GENE, "start", "end", "translation"))
    able = able.where((size >= min_length) & ((size <= max_length) if max_length else F.lit(True)) & F.col("translation").rlike(regex)).select("record_id", "start", "end")
    wide = genes.join(anchors, GENE, "left_semi").select("record_id", "gene_id", (F.col("start") - distance).alias("start"), (F.col("end") + distance).alias("end"))
    return range_join(wide, able, ["record_id"], max(1, 2 * distance), how="contain").select("record_id", F.col("l.gene_id").alias("gene_id")).distinct()

"""Reference sets from annotated regions: tables, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import prefix_totals

#: Regions longer than this are left out.
LONGEST = 500_000


def _label(column: str, missing: str) -> Column:
    """A label as it may stand in a header: blanks as ``_``, and a word for none."""
    return F.coalesce(F.regexp_replace(F.col(column), r"\s", "_"), F.lit(missing))


def _place(before: str, start: str, end: str) -> Column:
    return F.concat(F.lit(before), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def _joined(column: str) -> Column:
    """A label of the genes in ``g``, in their order."""
    # Most regions have one gene, which needs no function over arrays.
    return F.when(F.size("g") == 1, F.element_at("g", 1)[column]).otherwise(F.array_join(F.transform("g", lambda g: g[column]), ";"))


def clusters_of(genes: DataFrame, edge: int) -> DataFrame:
    """``record_id, region, cluster, tags, proteins`` of the clusters of ``build_cluster_reference``, from ``areas.record_regions`` with ``locus_tag`` and ``protein_id``: rows stay as they are dealt.

    Regions that begin before ``edge`` are at an edge.
    """
    gene = F.struct("start", "end", _label("locus_tag", "no_locus_tag").alias("tag"), _label("protein_id", "no_accession").alias("protein"))
    listed = genes.groupBy("record_id", "region").agg(F.min("area_start").alias("start"), F.max("area_end").alias("end"), F.sort_array(F.collect_list(gene)).alias("g"))
    whole = listed.where((F.col("start") >= edge) & (F.col("end") - F.col("start") <= LONGEST))
    return whole.select("record_id", "region", _place("c", "start", "end").alias("cluster"), _joined("tag").alias("tags"), _joined("protein").alias("proteins"))


def build_cluster_reference(regions: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters (``accession, description, cluster, products, tags, proteins``) and proteins (``accession, region, start, header, seq``) of whole regions.

    ``regions`` has ``accession, description, region, start, end, products, at_edge``; ``genes`` ``region, start, end, strand, locus_tag, annotation, protein_id, translation``. Regions at
    an edge or longer than ``LONGEST`` are left out. A region's genes are few, so their labels are one string.
    """
    whole = regions.where(~F.col("at_edge") & (F.col("end") - F.col("start") <= LONGEST)).withColumn("cluster", _place("c", "start", "end"))
    named = genes.withColumns({"tag": _label("locus_tag", "no_locus_tag"), "note": _label("annotation", "(unknown)"), "protein": _label("protein_id", "no_accession")})
    rows = whole.drop("start", "end").join(named, "region")
    listed = rows.groupBy("region", "accession", "description", "cluster", "products").agg(F.sort_array(F.collect_list(F.struct("start", "end", "tag", "protein"))).alias("g"))
    clusters = listed.select("region", "accession", "description", "cluster", "products", _joined("tag").alias("tags"), _joined("protein").alias("proteins"))
    place = F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
    header = F.concat_ws("|", "accession", "cluster", place, F.when(F.col("strand") == 1, "+").otherwise("-"), F.concat(F.lit("linearised"), place), "tag", "note", "protein")
    return clusters, rows.select("accession", "region", "start", F.concat(F.lit(">"), header).alias("header"), F.col("translation").alias("seq"))


def write_cluster_reference(clusters: DataFrame, proteins: DataFrame, path: str) -> None:
    """The tab table and the FASTA text that the readers take."""
    clusters.orderBy("accession", "cluster").select("accession", "description", "cluster", "products", "tags", "proteins").write.csv(f"{path}/clusters", sep="\t", quote="")
    proteins.orderBy("accession", "region", "start").select(F.concat("header", F.lit("\n"), "seq").alias("value")).write.text(f"{path}/proteins")


def build_component_reference(regions: DataFrame, genes: DataFrame, functions: DataFrame, profiles: DataFrame, modules: DataFrame) -> DataFrame:
    """Per region ``record_id, region, start, end`` (first gene's start to last gene's end) and ``genes``: each with its function, profiles and modules.

    A gene's function is ``core`` if any tool says so, else what ``smcogs`` says, else ``rule-based-clusters``, else ``other`` (``functions``: ``gene_id, tool, function, ord``).
    Subtypes of condensations are not kept in modules (``gene_id, module, domains, kind, complete``). Regions at an edge are left out.
    """
    told = lambda tool: F.min_by(F.when(F.col("tool") == tool, F.col("function")), F.when(F.col("tool") == tool, F.col("ord")))
    role = functions.groupBy("gene_id").agg(F.max((F.col("function") == "core").cast("int")).alias("core"), told("smcogs").alias("a"), told("rule-based-clusters").alias("b"))
    role = role.select("gene_id", F.when(F.col("core") == 1, "core").otherwise(F.coalesce("a", "b", F.lit("other"))).alias("function"))
    names = profiles.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("ord", "profile"))).alias("p")).select("gene_id", F.transform("p", lambda p: p["profile"]).alias("secmet"))
    plain = F.transform("domains", lambda d: F.regexp_replace(d, "^Condensation_.*$", "Condensation"))
    built = modules.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("module", plain.alias("domains"), "kind", "complete"))).alias("modules"))
    rows = genes.join(role, "gene_id", "left").join(names, "gene_id", "left").join(built, "gene_id", "left")
    gene = F.struct("start", "end", "gene_id", F.coalesce("function", F.lit("other")).alias("function"), F.coalesce("secmet", F.array().cast("array<string>")).alias("secmet"), "modules")
    nested = rows.groupBy("region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(gene)).alias("genes"))
    return regions.where(~F.col("at_edge")).select("record_id", "region", "products").join(nested, "region")


def build_core_reference(motifs: DataFrame) -> DataFrame:
    """``entry, accession, gene, kind, core``: peptide cores numbered over all accessions.

    ``motifs`` has ``accession, gene, kind, core, ord``. A core that an accession has from several motifs is of ``multiple genes``; a gene with several cores names which one.
    Brackets and quotes go, letters become upper case; entries are numbered in order of accession and first motif.
    """
    clean = motifs.withColumn("core", F.upper(F.translate("core", "[]'", "")))
    numbered = clean.withColumns({"_n": F.row_number().over(Window.partitionBy("accession", "gene").orderBy("ord")), "_of": F.count("*").over(Window.partitionBy("accession", "gene"))})
    name = F.when(F.col("_of") > 1, F.format_string("%s (core %d)", "gene", "_n")).otherwise(F.col("gene"))
    grouped = numbered.withColumn("name", name).groupBy("accession", "core").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("kind").alias("kind"), F.min("ord").alias("ord"))
    placed = prefix_totals(grouped, [], ["accession", "ord", "core"], rows="_before")
    return placed.select((F.col("_before") + 1).alias("entry"), "accession", F.when(F.col("n") > 1, "multiple genes").otherwise(F.col("name")).alias("gene"), "kind", "core")

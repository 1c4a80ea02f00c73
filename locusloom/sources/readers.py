"""Readers of sequence, annotation, alignment and reference files, each one distributed scan of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENT = "query string, subject string, identity double, length int, mismatches int, gaps int, q_start int, q_end int, s_start int, s_end int, evalue double, score double"
GFF = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"


def _checked(df: DataFrame, good: Column, message: str) -> DataFrame:
    """The same rows; one that is not good is an error when it is read."""
    return df.where(F.assert_true(good, F.lit(message)).isNull())


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: headers with blanks as ``_``, wrapped lines joined; a header without sequence or a line with other than letters is an error."""
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("block")).where("trim(block) <> ''")
    lines = F.split("block", "\r?\n")
    rows = blocks.select(F.replace(F.element_at(lines, 1), F.lit(" "), F.lit("_")).alias("name"), F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x)), "").alias("seq"))
    return _checked(rows, (F.length("seq") > 0) & F.col("seq").rlike(r"^[A-Za-z*-]+$"), "FASTA with a header that has no proper sequence")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """``seqid, type, parent, start, end, strand, parts, attributes``: rows of one type and parent are one feature of several parts.

    Parts are in order of start, reversed on the reverse strand; attributes that differ between parts are dropped.
    """
    rows = spark.read.schema(GFF).csv(path, sep="\t", comment="#")
    pairs = F.filter(F.split("attributes", ";"), lambda p: F.contains(p, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value"))))
    typed = rows.select("seqid", "type", (F.col("start") - 1).alias("start"), "end", F.when(F.col("strand") == "-", -1).when(F.col("strand") == "+", 1).otherwise(0).alias("strand"), attributes.alias("attributes"))
    key = F.coalesce(F.try_element_at("attributes", F.lit("Parent")), F.try_element_at("attributes", F.lit("ID")), F.concat_ws(":", "start", "end"))
    grouped = typed.withColumn("parent", key).groupBy("seqid", "type", "parent", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "end", "strand"))).alias("parts"), F.collect_list("attributes").alias("all")
    )
    shared = F.map_filter(F.element_at("all", 1), lambda k, v: F.forall("all", lambda m: F.try_element_at(m, k) == v))
    return grouped.select("seqid", "type", "parent", "start", "end", "strand", F.when(F.col("strand") == -1, F.reverse("parts")).otherwise(F.col("parts")).alias("parts"), shared.alias("attributes"))


def check_annotations(features: DataFrame, sequences: DataFrame) -> None:
    """Raise where annotations and sequences share no id (a single one on both sides is taken as the same), or no CDS is there."""
    if features.where("type = 'CDS'").isEmpty():
        raise ValueError("no CDS features")
    ids, names = features.select(F.col("seqid").alias("name")).distinct(), sequences.select("name").distinct()
    if ids.limit(2).count() == 1 and names.limit(2).count() == 1:
        return
    if ids.join(names, "name", "left_semi").isEmpty():
        raise ValueError("annotations and sequences share no id")


def read_hits(spark: SparkSession, path: str, query_lengths: DataFrame) -> DataFrame:
    """12-column alignments with ``accession``, ``ref_gene`` and ``coverage`` of the query (``query, query_length``)."""
    rows = spark.read.schema(ALIGNMENT).csv(path, sep="\t").join(query_lengths, "query")
    return rows.withColumns({"accession": F.split_part("subject", F.lit("|"), F.lit(1)), "ref_gene": F.split_part("subject", F.lit("|"), F.lit(-1)), "coverage": 100.0 * F.col("length") / F.col("query_length")})


def read_reference_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``accession, description, cluster, type, tags, proteins`` of a tab table; empty proteins are dropped."""
    rows = spark.read.schema("accession string, description string, cluster string, type string, tags string, proteins string").csv(path, sep="\t", quote="")
    return rows.withColumns({"tags": F.split("tags", ";"), "proteins": F.filter(F.split("proteins", ";"), lambda p: p != "")})


def read_reference_proteins(spark: SparkSession, path: str) -> DataFrame:
    """``ref_gene, accession, cluster, location, strand, tag, annotation, name`` of FASTA headers; annotations may hold ``|``."""
    shape = r"^>([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(?:(linearised[AB])\|)?([^|]*)\|(.*)\|([^|]*)$"
    names = ("accession", "cluster", "location", "strand", "linearised", "tag", "annotation", "name")
    rows = spark.read.text(path).where("value like '>%'").select(*[F.regexp_extract("value", shape, k + 1).alias(n) for k, n in enumerate(names)])
    return _checked(rows, F.col("accession") != "", "reference protein with a malformed header").withColumn("ref_gene", F.concat_ws("_", "accession", "tag")).drop("linearised")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """``profile, term, term_id`` of mapping lines; lines that begin with ``!`` are comments."""
    shape = r"^Pfam:(\S+) \S+ > GO:(.*) ; (GO:\d+)"
    rows = spark.read.text(path).where("value not like '!%' and trim(value) <> ''").select(*[F.regexp_extract("value", shape, k + 1).alias(n) for k, n in enumerate(("profile", "term", "term_id"))])
    return _checked(rows, F.col("term_id") != "", "malformed mapping line")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``matrix, position, base, weight, min_score, max_score`` of a JSON object of matrices with rows per base; an absent lowest score is 0."""
    body = "map<string, struct<pwm: map<string, array<double>>, min_score: double, max_score: double>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", body)).alias("matrix", "m"))
    bases = rows.select("matrix", F.coalesce("m.min_score", F.lit(0.0)).alias("min_score"), "m.max_score", F.explode("m.pwm").alias("base", "weights"))
    return bases.select("matrix", F.posexplode("weights").alias("position", "weight"), "base", "min_score", "max_score")


def read_equivalence_groups(spark: SparkSession, path: str, profiles: DataFrame) -> DataFrame:
    """``group_id, profile``: one comma list per line; an unknown profile is an error."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.xxhash64("value").alias("group_id"), F.explode(F.transform(F.split("value", ","), lambda x: F.trim(x))).alias("profile"))
    known = profiles.select("profile", F.lit(True).alias("_known"))
    return _checked(rows.join(known, "profile", "left"), F.col("profile").isNotNull() & F.col("_known").isNotNull(), "equivalence group with an unknown profile").select("group_id", "profile")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``profile, accession, length, n_seeds, cutoff`` of concatenated profile texts; one without trusted cutoff is an error."""
    blocks = spark.read.option("lineSep", "//\n").text(path).where("value rlike '(?m)^NAME '")
    field = lambda name, shape: F.regexp_extract("value", rf"(?m)^{name}\s+{shape}", 1)
    rows = blocks.select(field("NAME", r"(\S+)").alias("profile"), field("ACC", r"(\S+)").alias("accession"), field("LENG", r"(\d+)").cast("int").alias("length"), F.nullif(field("NSEQ", r"(\d+)"), F.lit("")).cast("int").alias("n_seeds"), field("TC", r"(-?[\d.]+)").alias("tc"))
    return _checked(rows, F.col("tc") != "", "profile without trusted cutoff").withColumn("cutoff", F.col("tc").cast("double")).drop("tc")


def read_results(spark: SparkSession, path: str, schema: str, versions: Sequence[int]) -> DataFrame:
    """Earlier results (JSON lines with ``schema_version``) of compatible versions."""
    return spark.read.schema(f"schema_version int, {schema}").json(path).where(F.col("schema_version").isin(*versions))


def read_sideloaded(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """``record_id, tool, kind, label, start, end``: areas of a JSON document, for records (``record_id, name, original_id``) that are there."""
    area = "array<struct<start: bigint, end: bigint, label: string, product: string>>"
    body = f"struct<tool: struct<name: string>, records: array<struct<name: string, subregions: {area}, protoclusters: {area}>>>"
    named = spark.read.text(path, wholetext=True).select(F.from_json("value", body).alias("d")).select(F.col("d.tool.name").alias("tool"), F.explode("d.records").alias("r"))
    kinds = [named.select("tool", F.col("r.name").alias("name"), F.lit(kind).alias("kind"), F.explode(f"r.{column}").alias("a")) for kind, column in (("sub", "subregions"), ("proto", "protoclusters"))]
    rows = kinds[0].unionByName(kinds[1])
    ids = records.select("record_id", F.explode(F.array_distinct(F.array_compact(F.array("name", "original_id")))).alias("name"))
    return rows.join(ids, "name").select("record_id", "tool", "kind", F.coalesce("a.label", "a.product").alias("label"), "a.start", "a.end")

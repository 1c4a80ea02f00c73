"""Queries on joins of features, areas, hits and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as ops
from ..registry import query
from ..tables import table, with_tables
from .areas import _AREAS_SQL, DAY, plain_areas

#: Terms per profile.
TERMS = [("AF", 101), ("AF", 102), ("NO", 201), ("RF", 301), ("RF", 302), ("RF", 303)]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{p}', {t})" for p, t in TERMS) + ") terms(profile, term_id)"
FUNCTIONS = [("AF", "biosynthetic", 10000.0), ("NO", "transport", 30000.0), ("RO", "regulatory", 50000.0)]
_FUNCTIONS_SQL = "(VALUES " + ", ".join(f"('{p}', '{f}', {s})" for p, f, s in FUNCTIONS) + ") fn(profile, function, min_score)"


@query("D1_within", with_tables(f'{_AREAS_SQL} SELECT a.record_id, area_id, gene_id FROM areas a JOIN genes g ON a.record_id = g.record_id AND a."start" <= g."start" AND g."end" <= a."end" ', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.within(table(spark, folder, "genes"), plain_areas(spark, folder), 4000)


@query("D1_within_overlapping", with_tables(f'{_AREAS_SQL} SELECT a.record_id, area_id, gene_id FROM areas a JOIN genes g ON a.record_id = g.record_id AND a."start" < g."end" AND g."start" < a."end" ', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.within(table(spark, folder, "genes"), plain_areas(spark, folder), 4000, with_overlapping=True)


@query("D2_neighbours", with_tables(f"""SELECT a.record_id, a.gene_id AS a, b.gene_id AS b, greatest(0, b."start" - a."end", a."start" - b."end") AS distance
    FROM moments a JOIN moments b ON a.record_id = b.record_id AND a.gene_id < b.gene_id AND greatest(b."start" - a."end", a."start" - b."end") < {DAY}""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.neighbours(table(spark, folder, "moments"), DAY)


@query("D3_nearest_with_profile", with_tables(f"""SELECT a.record_id, a.gene_id, coalesce(min(CASE WHEN b.gene_id IS NOT NULL THEN greatest(0, b."start" - a."end", a."start" - b."end") END), -1) AS distance
    FROM moments a LEFT JOIN moments b ON a.record_id = b.record_id AND b.profile IN ('purchase', 'signup') AND greatest(b."start" - a."end", a."start" - b."end") < {DAY} GROUP BY ALL""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    return ops.nearest_with_profile(moments, moments, ["purchase", "signup"], DAY)


@query("D4_map_ontology", with_tables(f"SELECT record_id, gene_id, profile, term_id FROM hits JOIN {_TERMS_SQL} USING (profile)", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.map_ontology(table(spark, folder, "hits"), spark.createDataFrame(TERMS, "profile string, term_id int")).select("record_id", "gene_id", "profile", "term_id")


_REFERENCE = "reference AS (SELECT DISTINCT ref_gene, CAST(ref_gene % 7 AS BIGINT) AS area FROM alignments UNION SELECT DISTINCT ref_gene, CAST(100 + ref_gene % 5 AS BIGINT) FROM alignments WHERE ref_gene % 3 = 0)"


@query("D5_resolve_reference_hits", with_tables(f", {_REFERENCE} SELECT query_id, ref_gene, ord, area FROM alignments JOIN reference USING (ref_gene)", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    alignments = table(spark, folder, "alignments")
    genes = alignments.select("ref_gene").distinct()
    reference = genes.select("ref_gene", (F.col("ref_gene") % 7).alias("area")).unionByName(genes.where("ref_gene % 3 = 0").select("ref_gene", (F.col("ref_gene") % 5 + 100).alias("area")))
    return ops.resolve_reference_hits(alignments, reference).select("query_id", "ref_gene", "ord", "area")


@query("D6_hits_in_area", with_tables("SELECT region, query_id, ref_gene, ord FROM alignments WHERE query_id IN (SELECT query_id FROM alignments WHERE identity > 95)", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    alignments = table(spark, folder, "alignments")
    return ops.hits_in_area(alignments, alignments.where("identity > 95")).select("region", "query_id", "ref_gene", "ord")


@query("D7_drop_self_hits", with_tables("SELECT region, ref_area, count(*) AS n FROM alignments WHERE 'rec' || ref_area <> 'rec' || region GROUP BY ALL", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "alignments").groupBy("region", "ref_area").agg(F.count("*").alias("n"))
    named = counted.withColumns({"accession": F.concat(F.lit("rec"), "ref_area"), "record_name": F.concat(F.lit("rec"), "region", F.lit(".1"))})
    return ops.drop_self_hits(named).select("region", "ref_area", "n")


@query("D8_annotate_subtypes", with_tables("""SELECT h.record_id, h.ord, coalesce(string_agg(DISTINCT s.profile, ',' ORDER BY s.profile), '') AS subtypes FROM hits h LEFT JOIN hits s ON h.record_id = s.record_id AND h.gene_id = s.gene_id AND s.profile IN ('NO', 'RF') AND h."start" < s."end" AND s."start" < h."end"
    WHERE h.profile = 'AF' GROUP BY ALL""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    secondary = hits.where("profile in ('NO', 'RF')").withColumn("profile", F.concat("profile", F.lit("_"), (F.col("ord") % 9).cast("string")))
    return ops.annotate_subtypes(hits, secondary, "AF").select("record_id", "ord", F.array_join("subtypes", ",").alias("subtypes"))


@query("D9_followers", with_tables("""SELECT record_id, gene_id, CASE WHEN strand = -1 THEN CASE WHEN lag(strand) OVER w = strand THEN lag(gene_id) OVER w END ELSE CASE WHEN lead(strand) OVER w = strand THEN lead(gene_id) OVER w END END AS follower
    FROM genes WINDOW w AS (PARTITION BY record_id ORDER BY "start", "end", gene_id)""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.followers(table(spark, folder, "genes"))


_SPAN = 'lengths AS (SELECT record_id, max("end") + 500 AS length FROM moments GROUP BY record_id)'


@query("D10_areas_by_gene", with_tables(f""", {_SPAN}, names AS (SELECT gene_id * 3 AS gene_id FROM moments)
    SELECT gene_id, record_id, CASE WHEN "start" IS NOT NULL THEN greatest(0, "start" - 20000) END AS "start", CASE WHEN "end" IS NOT NULL THEN least(length, "end" + 20000) END AS "end" FROM names LEFT JOIN moments USING (gene_id) LEFT JOIN lengths USING (record_id)""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    lengths = moments.groupBy("record_id").agg((F.max("end") + 500).alias("length"))
    return ops.areas_by_gene(moments, moments.select((F.col("gene_id") * 3).alias("gene_id")), lengths)


@query("D11_points_in_areas", with_tables(f'{_AREAS_SQL} SELECT DISTINCT g.record_id, gene_id AS point_id, g."start" + 40 AS position FROM genes g JOIN areas a ON a.record_id = g.record_id AND product = \'AF\' AND a."start" <= g."start" + 40 AND g."start" + 40 < a."end" ', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "genes").select("record_id", F.col("gene_id").alias("point_id"), (F.col("start") + 40).alias("position"))
    return ops.points_in_areas(points, plain_areas(spark, folder).where("product = 'AF'"), 4000)


@query("D12_empty_areas", with_tables(f"""{_AREAS_SQL} SELECT record_id, area_id FROM areas a WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.record_id = a.record_id AND a."start" <= g."start" AND g."end" <= a."end" AND score > 60000)""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.empty_areas(plain_areas(spark, folder), table(spark, folder, "genes").where("score > 60000"), 4000).select("record_id", "area_id")


@query("D13_annotate_functions", with_tables(f"SELECT record_id, gene_id, profile, function FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY record_id, gene_id ORDER BY score DESC, ord) = 1) JOIN {_FUNCTIONS_SQL} USING (profile) WHERE score >= min_score", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.hits import best_per_gene

    metadata = spark.createDataFrame(FUNCTIONS, "profile string, function string, min_score double")
    return ops.annotate_functions(best_per_gene(table(spark, folder, "hits")), metadata).select("record_id", "gene_id", "profile", "function")

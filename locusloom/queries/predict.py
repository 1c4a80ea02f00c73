"""Queries on predictions, summaries and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predict as ops
from ..operators.hits import overlap_groups
from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals
from ..registry import query
from ..tables import table, with_tables

_PRED = """pred AS (SELECT gene_id // 10 AS area_id, CASE WHEN ord % 4 = 0 THEN profile || '/' || lower(profile) ELSE profile END AS name, score, evalue FROM hits)"""


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hits")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("ord") % 4 == 0, F.concat("profile", F.lit("/"), F.lower("profile"))).otherwise(F.col("profile"))
    return _hits(spark, folder).select(F.expr("gene_id div 10").alias("area_id"), name.alias("name"), "score", "evalue")


@query("J1_sum_predictions", with_tables(f""", {_PRED}, s AS (SELECT area_id, unnest(string_split(name, '/')) AS n, score / len(string_split(name, '/')) AS score, evalue FROM pred) SELECT area_id, n AS name, round(sum(score), 3) AS score, min(evalue) AS evalue FROM s GROUP BY ALL""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.sum_predictions(_predictions(spark, folder)).withColumn("score", F.round("score", 3))


CLASSES = [("AF", "x"), ("AF", "y"), ("NO", "x"), ("NF", "x"), ("NF", "z"), ("RO", "y"), ("RF", "x"), ("AO", "x")]


@query("J2_common_classes", with_tables(f""", p AS (SELECT DISTINCT gene_id AS area_id, profile AS name FROM hits), c(name, class) AS (VALUES {", ".join(map(str, CLASSES))})
    SELECT area_id, class FROM p JOIN c USING (name) JOIN (SELECT area_id, count(*) AS k FROM p GROUP BY area_id) USING (area_id) GROUP BY area_id, class HAVING count(DISTINCT name) = any_value(k)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.common_classes(_hits(spark, folder).select(F.col("gene_id").alias("area_id"), F.col("profile").alias("name")), spark.createDataFrame(CLASSES, "name string, class string"))


@query("J3_mass_combinations", with_tables("""SELECT a.gene_id AS area_id, a.ord AS starter, b.ord AS elongation, round(a.score + b.score + coalesce((SELECT sum(score) FROM hits t WHERE t.gene_id = a.gene_id AND profile = 'NO'), 0), 2) AS mass FROM hits a JOIN hits b ON a.gene_id = b.gene_id AND a.profile = 'AF' AND b.profile = 'RF'""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda profile, name: _hits(spark, folder).where(F.col("profile") == profile).select(F.col("gene_id").alias("area_id"), F.col("ord").alias(name), F.col("score").alias("weight"))
    return ops.mass_combinations(part("AF", "starter"), part("RF", "elongation"), part("NO", "tailoring")).withColumn("mass", F.round("mass", 2))


@query("J4_prediction_table", with_tables("""SELECT ord, CASE WHEN ord % 2 = 0 THEN 'KS' ELSE 'CLF' END AS type, profile AS function FROM hits UNION ALL SELECT ord, 'KR', profile || '_2' FROM hits WHERE ord % 3 = 0""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    first = _hits(spark, folder).select("ord", F.concat(F.when(F.col("ord") % 2 == 0, "KS").otherwise("CLF"), F.lit("_"), "profile").alias("name"))
    second = _hits(spark, folder).select("ord", F.concat(F.when(F.col("ord") % 3 == 0, "KR").otherwise("X"), F.lit("_"), "profile", F.lit("_2")).alias("name"))
    return ops.prediction_table(first, second, ["KS", "CLF", "KR"]).select("ord", "type", "function")


REACTIONS = [("AF", "s1", "p1"), ("AF", "s1", "p2"), ("NO", "s1", "p1"), ("NF", "s1", "p1"), ("RO", "s2", "p3"), ("RF", "s1", "p1"), ("AO", "s1", "p2")]


@query("J5_merge_reactions", with_tables(f""", g AS (SELECT DISTINCT gene_id AS group_id, profile FROM hits), r(profile, substrate, product) AS (VALUES {", ".join(map(str, REACTIONS))}), z AS (SELECT group_id, count(*) AS n FROM g GROUP BY ALL)
    SELECT group_id, substrate, product FROM g JOIN r USING (profile) JOIN z USING (group_id) GROUP BY group_id, substrate, product HAVING count(DISTINCT profile) = any_value(n)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    groups = _hits(spark, folder).select(F.col("gene_id").alias("group_id"), "profile")
    return ops.merge_reactions(groups, spark.createDataFrame(REACTIONS, "profile string, substrate string, product string"))


@query("J6_group_prediction", with_tables("""
    , r AS (SELECT *, max("end") OVER (PARTITION BY record_id, gene_id ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
    g AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR "start" >= reach - 20 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, gene_id ORDER BY "start", "end", ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS overlap_group FROM r)
    SELECT record_id, gene_id, overlap_group, min("start") AS "start", max("end") AS "end", CASE WHEN count(DISTINCT profile) > 1 THEN 'ambiguous' ELSE min(profile) END AS type FROM g GROUP BY ALL""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.group_prediction(overlap_groups(_hits(spark, folder)).withColumn("type", F.col("profile")))


PRIORITY = [("AF", 2), ("NO", 1), ("NF", 3), ("RO", 3)]


@query("J6_area_products", with_tables(f""", p(type, priority) AS (VALUES {", ".join(map(str, PRIORITY))}) SELECT DISTINCT area_id, product FROM (SELECT gene_id AS area_id, ord % 5 AS product, priority, min(priority) OVER (PARTITION BY gene_id) AS best FROM hits JOIN p ON profile = type) WHERE priority = best""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _hits(spark, folder).select(F.col("gene_id").alias("area_id"), (F.col("ord") % 5).alias("product"), F.col("profile").alias("type"))
    return ops.area_products(rows, spark.createDataFrame(PRIORITY, "type string, priority int"))


_NOTES = """notes AS (SELECT record_id, gene_id // 7 AS gene_id, profile AS tool, CASE CAST(floor(score) AS BIGINT) % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'transport' ELSE CASE WHEN score > 150 THEN 'core' ELSE 'regulatory' END END AS function FROM moments)"""


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.floor("score") % 3
    function = F.when(kind == 0, "other").when(kind == 1, "transport").otherwise(F.when(F.col("score") > 150, "core").otherwise("regulatory"))
    return table(spark, folder, "moments").select("record_id", F.expr("gene_id div 7").alias("gene_id"), F.col("profile").alias("tool"), function.alias("function"))


@query("J7_resolve_function", with_tables(f""", {_NOTES} SELECT record_id, gene_id, CASE WHEN bool_or(function = 'core') THEN 'core' WHEN min(CASE WHEN tool = 'click' AND function <> 'other' THEN function END) IS NOT NULL THEN min(CASE WHEN tool = 'click' AND function <> 'other' THEN function END) WHEN count(DISTINCT function) = 1 THEN min(function) ELSE 'other' END AS function FROM notes GROUP BY ALL""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.resolve_function(_notes(spark, folder), "click")


@query("J8_tailoring_table", with_tables(f""", {_NOTES} SELECT record_id % 9 AS region, record_id, gene_id, string_agg(DISTINCT tool || ':' || function, ',' ORDER BY tool || ':' || function) AS hits FROM notes WHERE tool IN ('click', 'view') GROUP BY ALL""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder)
    members = notes.select((F.col("record_id") % 9).alias("region"), "record_id", "gene_id").distinct()
    found = ops.tailoring_table(members, [notes.where("tool = 'click'"), notes.where("tool = 'view'")])
    return found.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat(h["tool"], F.lit(":"), h["function"])), ","))


@query("J9_gene_overview", with_tables(f""", {_NOTES} SELECT record_id, gene_id, string_agg(DISTINCT function, ',' ORDER BY function) AS functions, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, string_agg(tool, ',' ORDER BY tool) AS descriptions FROM notes GROUP BY ALL""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.gene_overview(_notes(spark, folder).withColumn("description", F.col("tool")))


@query("J10_stage_totals", with_tables("SELECT profile AS stage, round(sum(score), 2) AS seconds FROM moments GROUP BY ALL", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.stage_totals(table(spark, folder, "moments").select(F.col("profile").alias("stage"), F.col("score").alias("seconds"))).withColumn("seconds", F.round("seconds", 2))


def _promoter_sql(source: str, up: int, down: int) -> str:
    return f"""near AS (SELECT *, lag("end") OVER w AS pe, lag(strand) OVER w AS ps, lead("start") OVER w AS ns, lead("end") OVER w AS ne, lead(strand) OVER w AS nst, lead(gene_id) OVER w AS nid FROM {source} WINDOW w AS (PARTITION BY record_id ORDER BY "start", "end", gene_id)),
    faced AS (SELECT *, coalesce(strand = -1 AND nst = 1 AND "end" + {up} >= ns - {up}, false) AS faces, coalesce(strand = 1 AND ps = -1 AND pe + {up} >= "start" - {up}, false) AS taken FROM near),
    windows AS (SELECT record_id, gene_id, CASE WHEN faces THEN nid END AS other_id, CASE WHEN strand = 1 THEN greatest("start" - {up}, coalesce(pe, 0)) ELSE greatest("end" - {down}, "start") END AS low,
        CASE WHEN faces THEN least(ns + {down}, ne) WHEN strand = 1 THEN least("start" + {down}, "end") ELSE least("end" + {up}, coalesce(ns, "end" + {up})) END AS high FROM faced WHERE NOT taken)"""


@query("J11_promoters", with_tables(f""", {_promoter_sql("genes", 1000, 50)} SELECT record_id, gene_id, other_id, low AS "start", high AS "end" FROM windows WHERE low < high""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.promoters(table(spark, folder, "genes"))


_SPOTS = """spots AS (SELECT record_id, record_id * 8 + k AS gene_id, CAST(k * (100 + record_id % 90) + 40 AS BIGINT) AS "start", CAST(k * (100 + record_id % 90) + 100 AS BIGINT) AS "end", CASE WHEN (record_id + k) % 3 = 0 THEN -1 ELSE 1 END AS strand FROM nucleotides, range(0, 8) t(k))"""


@query("J11_promoter_sequences", with_tables(f""", {_SPOTS}, {_promoter_sql("spots", 60, 20)}, cut_out AS (SELECT record_id, gene_id, other_id, upper(substr(seq, CAST(low + 1 AS INT), CAST(high - low AS INT))) AS promoter FROM windows JOIN nucleotides USING (record_id) WHERE low < high)
    SELECT * FROM cut_out WHERE length(promoter) BETWEEN 6 AND 161 AND contains(promoter, 'A') AND contains(promoter, 'C') AND contains(promoter, 'G') AND contains(promoter, 'T')""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    dna = table(spark, folder, "nucleotides")
    step, k = 100 + F.col("record_id") % 90, F.col("k")
    spots = dna.select("record_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("record_id", (F.col("record_id") * 8 + k).alias("gene_id"), (k * step + 40).alias("start"), (k * step + 100).alias("end"), F.when((F.col("record_id") + k) % 3 == 0, -1).otherwise(1).alias("strand"))
    return ops.promoter_sequences(ops.promoters(spots, 60, 20), dna, 6, 161).select("record_id", "gene_id", "other_id", "promoter")


_PLACES = "places AS (SELECT record_id, gene_id, profile, score, CAST(row_number() OVER (PARTITION BY record_id ORDER BY \"start\", \"end\", gene_id) AS INT) AS k FROM moments), n AS (SELECT record_id, CAST(count(*) AS INT) AS n FROM moments GROUP BY ALL), anchors AS (SELECT record_id, k AS anchor FROM places WHERE score > 100)"


def _places(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = prefix_totals(table(spark, folder, "moments"), ["record_id"], ["start", "end", "gene_id"], rows="k")
    places = cut(placed.withColumn("k", (F.col("k") + 1).cast("int")))
    return places, places.groupBy("record_id").agg(F.count("*").cast("int").alias("n")), places.where("score > 100").select("record_id", F.col("k").alias("anchor"))


@query("J12_promoter_sets", with_tables(f""", {_PLACES} SELECT DISTINCT record_id, anchor, first, last FROM (SELECT record_id, anchor, CAST(greatest(1, anchor - m) AS INT) AS first, CAST(least(n, anchor + p) AS INT) AS last FROM anchors JOIN n USING (record_id), range(0, 16) a(m), range(0, 16) b(p) WHERE m + p >= 3) WHERE last - first + 1 >= 4""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    _, counts, anchors = _places(spark, folder)
    return ops.promoter_sets(anchors, counts)


@query("J13_filter_motifs", with_tables(f""", {_PLACES} SELECT record_id, profile AS motif, 100.0::DOUBLE * count(DISTINCT k) / any_value(n) AS percent FROM places JOIN n USING (record_id) GROUP BY record_id, profile HAVING 100.0::DOUBLE * count(DISTINCT k) / any_value(n) <= 18 AND bool_or(score > 100)""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    places, counts, _ = _places(spark, folder)
    return ops.filter_motifs(places.select("record_id", F.col("profile").alias("motif"), F.col("k").alias("promoter"), (F.col("score") > 100).alias("is_anchor")), counts, 18.0)


_ISLANDS = f"""{_PLACES}, d AS (SELECT DISTINCT record_id, profile AS motif, k FROM places), b AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY record_id, motif ORDER BY k) <= 3 THEN 0 ELSE 1 END AS brk FROM d),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY record_id, motif ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM b), s AS (SELECT record_id, motif, min(k) AS first, max(k) AS last FROM i GROUP BY record_id, motif, isl),
    found AS (SELECT s.record_id, motif, anchor, first, last FROM s JOIN anchors a ON a.record_id = s.record_id AND anchor BETWEEN first AND last)"""


def _found(spark: SparkSession, folder: str) -> DataFrame:
    places, _, anchors = _places(spark, folder)
    return ops.motif_islands(places.select("record_id", F.col("profile").alias("motif"), F.col("k").alias("promoter")), anchors)


@query("J14_motif_islands", with_tables(f", {_ISLANDS} SELECT * FROM found", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder)


_BORDERS = f"""{_ISLANDS}, f AS (SELECT *, length(motif) AS score FROM found), l AS (SELECT record_id, anchor, first AS low, count(*) AS ln, min(score) AS ls FROM f GROUP BY ALL), h AS (SELECT record_id, anchor, last AS high, count(*) AS hn, min(score) AS hs FROM f GROUP BY ALL),
    borders AS (SELECT record_id, anchor, low, high, ln + hn AS abundance, CAST(least(ls, hs) AS INT) AS score FROM l JOIN h USING (record_id, anchor)), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id, anchor ORDER BY abundance DESC, score, low, high) AS INT) AS rank FROM borders)"""


@query("J15_border_predictions", with_tables(f", {_BORDERS} SELECT * FROM ranked", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.border_predictions(_found(spark, folder).withColumn("score", F.length("motif")))


@query("J16_check_predictions", with_tables(f""", {_BORDERS}, m AS (SELECT ranked.*, high - low + 1 >= 3 AND low > 10 AND high <= n - 10 AS sane FROM ranked JOIN n USING (record_id)), x AS (SELECT *, min(CASE WHEN sane THEN rank END) OVER (PARTITION BY record_id, anchor) AS f FROM m) SELECT * EXCLUDE (f) FROM x WHERE f IS NULL OR rank <= f""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    _, counts, _ = _places(spark, folder)
    return ops.check_predictions(ops.border_predictions(_found(spark, folder).withColumn("score", F.length("motif"))), counts)


DOMAIN_CLASSES = [("AF", "A"), ("AO", "AT"), ("NF", "C"), ("NO", "KS"), ("RF", "CP"), ("RO", "E")]


@query("I1_classify_domains", with_tables(f""", c(profile, class) AS (VALUES {", ".join(map(str, DOMAIN_CLASSES))}) SELECT ord, record_id, class FROM hits JOIN c USING (profile)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.classify_domains(_hits(spark, folder), spark.createDataFrame(DOMAIN_CLASSES, "profile string, class string")).select("ord", "record_id", "class")


@query("I5_number_domains", with_tables("""SELECT record_id, gene_id, ord, CAST(row_number() OVER (PARTITION BY record_id, gene_id, profile ORDER BY "start", "end", ord) AS INT) AS number FROM hits""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.number_domains(_hits(spark, folder)).select("record_id", "gene_id", "ord", "number")


_TOP = """v AS (SELECT record_id, gene_id, profile, count(*) AS n FROM hits {where} GROUP BY ALL), t AS (SELECT record_id, gene_id, count(*) AS k, min(profile) AS p FROM (SELECT *, max(n) OVER (PARTITION BY record_id, gene_id) AS m FROM v) WHERE n = m GROUP BY ALL)"""


@query("I6_dominant_subtype", with_tables(f", {_TOP.format(where='')} SELECT record_id, gene_id, CASE WHEN k = 1 THEN p ELSE 'mixed' END AS subtype FROM t", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dominant_subtype(_hits(spark, folder).withColumn("subtype", F.col("profile")))


@query("I7_consensus", with_tables(f""", {_TOP.format(where="WHERE profile IN ('AF', 'NO', 'RF')")} SELECT record_id, gene_id, CASE WHEN k = 1 THEN p ELSE 'none' END AS call FROM (SELECT DISTINCT record_id, gene_id FROM hits) LEFT JOIN t USING (record_id, gene_id)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.consensus(_hits(spark, folder).withColumn("call", F.col("profile")), ["AF", "NO", "RF"], "none")


@query("I9_rank_profiles", with_tables("SELECT record_id, gene_id, ord, CAST(row_number() OVER (PARTITION BY record_id, gene_id ORDER BY score DESC, profile, ord) AS INT) AS rank FROM hits", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.rank_profiles(_hits(spark, folder)).select("record_id", "gene_id", "ord", "rank")


_ORDERED = """ordered AS (SELECT record_id, gene_id, profile, CAST(row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN d < 0 THEN -"start" ELSE "start" END, gene_id) AS INT) AS place FROM (SELECT *, sum(strand) OVER (PARTITION BY record_id) AS d FROM genes))"""


@query("I11_colinear_order", with_tables(f", {_ORDERED} SELECT record_id, gene_id, place FROM ordered", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.colinear_order(table(spark, folder, "genes")).select("record_id", "gene_id", "place")


@query("I14_polymer", with_tables(f""", {_ORDERED} SELECT record_id, place, '(' || lower(profile) || ' - ' || profile || ')' AS text FROM ordered""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    # A record here has as many genes as its supplier has line items, so its polymer is given as ordered rows.
    ordered = ops.colinear_places(table(spark, folder, "genes"))
    modules = ordered.select("record_id", "place", F.explode(F.array(F.struct(F.lit(1).alias("number"), F.lower("profile").alias("monomer")), F.struct(F.lit(2).alias("number"), F.col("profile").alias("monomer")))).alias("m")).select("record_id", "place", "m.*")
    return ops.polymer_rows(modules)


@query("I15_count_enzyme_kinds", with_tables("""SELECT record_id, count(*) FILTER (p AND NOT n) AS pks, count(*) FILTER (n AND NOT p) AS nrps, count(*) FILTER (p AND n) AS hybrid FROM (SELECT record_id, gene_id, bool_or(profile IN ('AO', 'NO')) AS p, bool_or(profile NOT IN ('AO', 'NO')) AS n FROM hits WHERE score > 40000 GROUP BY ALL) GROUP BY ALL""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    modules = _hits(spark, folder).withColumns({"kind": F.when(F.col("profile").isin("AO", "NO"), "pks").otherwise("nrps"), "complete": F.col("score") > 40000})
    return ops.count_enzyme_kinds(modules)


@query("I17_domain_sequences", with_tables("""SELECT h.record_id, h.gene_id, ord, substr(repeat('MKTAYIAKQR', 60), CAST("start" AS INT) + 1, CAST("end" - "start" AS INT)) AS seq FROM hits h WHERE profile IN ('AF', 'NO')""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(spark, folder)
    genes = hits.select("record_id", "gene_id").distinct().withColumn("translation", F.repeat(F.lit("MKTAYIAKQR"), 60))
    return ops.domain_sequences(hits, genes, ["AF", "NO"])

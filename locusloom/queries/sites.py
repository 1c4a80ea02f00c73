"""Queries on sites, motifs, chosen hits, precursors, anchored detectors, circular records and reference sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas as area_ops
from ..operators import joins as join_ops
from ..operators import sites as ops
from ..operators.kernels import Kernel, kernel_scores
from ..operators.rules import Rule, Rules, evaluate_rules, profile
from ..operators.scans import peptide_features
from ..plans.checkpoints import cut
from ..plans.intervals import range_join
from ..registry import query
from ..sources import reference_sets
from ..tables import table, with_tables
from .areas import _REGIONS, DAY, MATCHED_SQL, RULES, islands_sql, plain_areas, plain_regions
from .scans import _PROTEIN, CLASSES, _proteins

_SITES = [("config", "K", [3, 7], "", [5], {"D": "D-form", "T": "T-form"}, "L-form"), ("active", "K", [4], "T", [6, 9], {"AN": "active", "ED": "active"}, "other"), ("ester", "R", [], "", [12], {"E": "ester"}, None)]
_SITE_TYPE = "site string, profile string, scaffold array<int>, expected string, target array<int>, labels map<string,string>, other string"


@query("H13_active_sites", with_tables(f""", a AS (SELECT record_id AS domain_id, CASE WHEN record_id % 2 = 0 THEN 'K' ELSE 'R' END AS profile, record_id % 3 AS hs, string_split(p, '') AS q, string_split(substr(p, 4, 1) || '..' || substr(p, 5), '') AS r FROM (SELECT record_id, {_PROTEIN} AS p FROM sequences)),
    k AS (SELECT *, list_filter(range(1, least(len(q), len(r)) + 1), lambda i: r[i] <> '.') AS c FROM a WHERE len(q) > 0),
    s AS (SELECT domain_id, 'config' AS site, CASE WHEN len(c) >= 7 THEN '' END AS scaffold, '' AS expected, CASE WHEN len(c) >= 5 - hs AND 5 - hs >= 1 THEN q[c[5 - hs]] END AS residues FROM k WHERE profile = 'K'
        UNION ALL SELECT domain_id, 'active', CASE WHEN len(c) >= 4 THEN q[c[4]] END, 'T', CASE WHEN len(c) >= 9 - hs THEN q[c[6 - hs]] || q[c[9 - hs]] END FROM k WHERE profile = 'K'
        UNION ALL SELECT domain_id, 'ester', '', '', CASE WHEN len(c) >= 12 - hs THEN q[c[12 - hs]] END FROM k WHERE profile = 'R')
    SELECT * FROM (SELECT domain_id, site, residues, CASE site WHEN 'config' THEN CASE residues WHEN 'D' THEN 'D-form' WHEN 'T' THEN 'T-form' ELSE 'L-form' END WHEN 'active' THEN CASE WHEN residues IN ('AN', 'ED') THEN 'active' ELSE 'other' END ELSE CASE WHEN residues = 'E' THEN 'ester' END END AS label FROM s
        WHERE (site = 'config' OR scaffold = expected) AND residues IS NOT NULL) WHERE label IS NOT NULL""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proteins(spark, folder).select(F.col("record_id").alias("domain_id"), F.when(F.col("record_id") % 2 == 0, "K").otherwise("R").alias("profile"), F.col("seq").alias("query"), F.concat(F.substring("seq", 4, 1), F.lit(".."), F.expr("substr(seq, 5)")).alias("reference"), (F.col("record_id") % 3).cast("int").alias("hit_start"))
    sites = spark.createDataFrame([s if s[0] != "config" else (*s[:2], [], *s[3:]) for s in _SITES], _SITE_TYPE)
    return ops.active_sites(rows, sites)


#: Residues that the checks of each database look for, by position; where two checks differ the later one wins.
_DATABASES = sorted({c[1] for c in ops.CHECKS})
_WANTED = {(d, p): r for d in _DATABASES for _, db, scaffold, expected, target, labels, _, _ in ops.CHECKS if db == d for p, r in [*zip(scaffold, expected, strict=True), *zip(target, next(iter(labels)), strict=True)]}
_SITE_WORDS = f"""a AS (SELECT record_id AS domain_id, p, ['{"', '".join(_DATABASES)}'][CAST(record_id % {len(_DATABASES)} + 1 AS INT)] AS profile, (record_id // 3) % 2 AS hs, CAST(250 + record_id % 190 AS INT) AS n FROM (SELECT record_id, {_PROTEIN} AS p FROM sequences) WHERE length(p) > 0)"""


@query("H13_site_checks", with_tables(f""", {_SITE_WORDS}, w(profile, at_, r) AS (VALUES {", ".join(f"('{d}', {p}, '{r}')" for (d, p), r in _WANTED.items())}),
    wm AS (SELECT profile, map(list(at_), list(r)) AS wanted FROM w GROUP BY profile),
    b AS (SELECT domain_id, profile, hs, list_transform(range(1, n + 1), lambda i: CASE WHEN (domain_id // 11 * 7 + i) % 19 > 0 THEN coalesce(wanted[CAST(i + CASE WHEN domain_id % 4 = 0 THEN hs ELSE 0 END AS INT)], substr(p, CAST((i * 7 + domain_id) % length(p) + 1 AS INT), 1)) ELSE substr(p, CAST((i * 7 + domain_id) % length(p) + 1 AS INT), 1) END) AS l, n FROM a JOIN wm USING (profile)),
    c(site, profile, scaffold, expected, target, labels, other, failed) AS (VALUES {", ".join(f"('{site}', '{db}', {list(sc)}, '{ex}', {list(ta)}, MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in labels.items())}}}, '{other}', {f'{chr(39)}{failed}{chr(39)}' if failed else 'NULL'})" for site, db, sc, ex, ta, labels, other, failed in ops.CHECKS)}),
    t AS (SELECT domain_id, site, labels, other, failed, CASE WHEN list_max(target) - hs <= n AND list_min(target) > hs THEN array_to_string(list_transform(target, lambda x: l[x - hs]), '') ELSE '' END AS residues,
        list_max(scaffold) <= n AND array_to_string(list_transform(scaffold, lambda x: l[x]), '') = expected AS scaffold FROM b JOIN c USING (profile))
    SELECT domain_id, site, residues, scaffold, replace(CASE WHEN NOT scaffold AND failed IS NOT NULL THEN failed ELSE coalesce(labels[residues], other) END, '{{scaffold}}', CASE WHEN scaffold THEN 'True' ELSE 'False' END) AS label FROM t""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proteins(spark, folder).where("length(seq) > 0").select(F.col("record_id").alias("domain_id"), "seq", F.element_at(F.array(*map(F.lit, _DATABASES)), (F.col("record_id") % len(_DATABASES) + 1).cast("int")).alias("profile"), F.expr("cast((record_id div 3) % 2 as int)").alias("hit_start"), (250 + F.col("record_id") % 190).cast("int").alias("n"))
    wanted = spark.createDataFrame([(d, {p: r for (x, p), r in _WANTED.items() if x == d}) for d in _DATABASES], "profile string, wanted map<int,string>")
    # Letters are taken from an array, as each would be sought from the start of a text.
    rows = rows.withColumn("letters", F.split("seq", "")).drop("seq").withColumn("n_letters", F.size("letters"))
    own = lambda i: F.element_at("letters", ((i * 7 + F.col("domain_id")) % F.col("n_letters") + 1).cast("int"))
    letter = lambda i: F.when((F.expr("domain_id div 11") * 7 + i) % 19 > 0, F.coalesce(F.try_element_at("wanted", i + F.when(F.col("domain_id") % 4 == 0, F.col("hit_start")).otherwise(0)), own(i))).otherwise(own(i))
    gap = lambda i: (F.col("domain_id") + i) % 17 == 0
    text = lambda insert, of: F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(gap(i), F.concat(F.lit(insert), of(i))).otherwise(of(i))), "")
    aligned = rows.join(F.broadcast(wanted), "profile").select("domain_id", "profile", "hit_start", text("X", letter).alias("query"), text(".", lambda i: F.lit("p")).alias("reference"))
    return ops.site_checks(aligned)


_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
_MOTIFS = [("AF", "m1", "C.E", 0, 1, 1, "trp"), ("AF", "m2", "DEF", 0, 2, 2, "tyr"), ("AF", "m3", "..G", 0, 1, 2, "phe"), ("NO", "m1", "K.M", 0, 2, 1, "hpg"), ("NO", "m2", "", 0, 0, 3, "any")]
_CUTOFFS = [("AF", [60000.0, 30000.0, 5000.0], 0.8, 0.15), ("NO", [40000.0, 2000.0], 0.5, 0.1), ("RF", [50000.0], 0.9, 0.1)]


@query("H14_match_motifs", with_tables(f""", m(profile, motif, pattern, least_, most_, preference, substrate) AS (VALUES {", ".join(map(str, _MOTIFS))}), p(profile, cutoffs, step, penalty) AS (VALUES {", ".join(map(str, _CUTOFFS))}),
    able AS (SELECT ord, h.profile, p.penalty::DOUBLE AS penalty, power(step::DOUBLE, len(list_filter(cutoffs, lambda c: h.score < c))) AS base, h."start" AS s FROM hits h JOIN p USING (profile) WHERE h.score >= cutoffs[-1]),
    f AS (SELECT a.*, m.motif, pattern, substrate, preference, least_, most_, CASE WHEN m.motif = 'm2' AND a.profile = 'NO' THEN '' ELSE substr('{_ACIDS}', CAST(s % 17 + 1 AS INT), 3) END AS residues FROM able a JOIN m USING (profile)),
    d AS (SELECT *, len(list_filter(range(1, length(pattern) + 1), lambda i: pattern[i] <> '.' AND residues[i] <> pattern[i])) AS distance FROM f),
    n AS (SELECT *, min(preference) OVER (PARTITION BY ord) AS best FROM d WHERE distance BETWEEN least_ AND most_),
    l AS (SELECT *, sum(CASE WHEN preference > best THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY preference, motif ROWS UNBOUNDED PRECEDING) AS later FROM n)
    SELECT ord AS hit_id, motif, substrate, round(greatest(0.0, base - later * penalty), 6) AS confidence FROM l UNION ALL SELECT ord, NULL, NULL, round(base, 6) FROM able WHERE profile = 'RF'""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    motifs = spark.createDataFrame(_MOTIFS, "profile string, motif string, pattern string, least int, most int, preference int, substrate string")
    hits = table(spark, folder, "hits").select(F.col("ord").alias("hit_id"), "profile", "score", "start")
    named = hits.join(motifs.select("profile", "motif", "pattern"), "profile")
    letters = F.substr(F.lit(_ACIDS), (F.col("start") % 17 + 1).cast("int"), F.lit(3))
    found = named.select("hit_id", "profile", "motif", F.when(F.col("pattern") == "", "").otherwise(letters).alias("residues"))
    matched = ops.match_motifs(hits.drop("start"), found, motifs, spark.createDataFrame(_CUTOFFS, "profile string, cutoffs array<double>, step double, penalty double"))
    return matched.withColumn("confidence", F.round("confidence", 6))


@query("H15_choose_hit", with_tables("""
    , g AS (SELECT record_id, gene_id, profile FROM hits WHERE profile IN ('AF', 'NF') QUALIFY row_number() OVER (PARTITION BY record_id, gene_id ORDER BY score DESC, ord) = 1),
    s AS (SELECT record_id, gene_id, profile, count(*) OVER (PARTITION BY record_id, gene_id, evalue) AS n FROM hits WHERE profile IN ('NO', 'RO') QUALIFY row_number() OVER (PARTITION BY record_id, gene_id ORDER BY evalue DESC, ord) = 1)
    SELECT g.record_id, g.gene_id, CASE WHEN g.profile = 'AF' AND n = 1 THEN s.profile ELSE g.profile END AS profile, coalesce(g.profile = 'AF' AND n = 1, false) AS is_specific FROM g LEFT JOIN s USING (record_id, gene_id)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    general = hits.where("profile in ('AF', 'NF')").withColumn("conventional", F.col("profile") == "AF")
    return ops.choose_hit(general, hits.where("profile in ('NO', 'RO')").withColumn("confidence", F.col("evalue")))


@query("H22_precursor_candidates", with_tables(f"""{_REGIONS}, i AS (SELECT r.record_id, r.region AS area_id, gene_id, g."start", g."end", profile, g."end" - g."start" AS size FROM regions r JOIN genes g ON g.record_id = r.record_id AND r."start" <= g."start" AND g."end" <= r."end"),
    c AS (SELECT * FROM i WHERE profile <> 'AF' AND (size < 60 OR (profile = 'NF' AND size <= 75)))
    SELECT a.record_id, a.area_id, a.gene_id AS core_id, c.gene_id FROM i a JOIN c ON c.record_id = a.record_id AND c.area_id = a.area_id AND c."start" < a."end" + 400 AND a."start" - 400 < c."end" WHERE a.profile = 'AF'""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    regions = area_ops.regions(plain_areas(spark, folder)).withColumnRenamed("region", "area_id")
    genes = table(spark, folder, "genes").withColumn("size", F.col("end") - F.col("start"))
    annotated = genes.where("profile not in ('AF', 'RF')").withColumn("known", F.col("profile") == "NF")
    return ops.precursor_candidates(regions, annotated, genes.where("profile = 'RF'"), genes.where("profile = 'AF'"), 20000, most=60, distance=400)


@query("H23_classifier_score")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Peptide features of all sequences; the classifier learns which ones the labels call good."""
    rows = cut(_proteins(spark, folder).select("record_id", *[c.cast("double") for c in peptide_features(F.col("seq"), CLASSES)]).toDF("record_id", *_FEATURES))
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality in (0, 1)").select(F.col("doc_id").alias("record_id"), F.col("quality").cast("double").alias("label"))
    model = ops.fit_classifier(cut(rows.join(labels, "record_id")), _FEATURES)
    return ops.classifier_score(rows, model).select("record_id", "score")


#: A model for vectors: the first vector of each label is a support vector, for even labels with weight 0.5, else -0.4.
_KERNEL = Kernel(0.35, 0.05, [0.01] * 64, [0.9] * 64)
_SCALED = f"list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - {_KERNEL.mean[0]}::DOUBLE) / {_KERNEL.scale[0]}::DOUBLE)"


@query("H23_kernel_score", f"""WITH e AS (SELECT vec_id, label, {_SCALED} AS x FROM embeddings WHERE len(embedding) = 64), sv AS (SELECT CASE WHEN label % 2 = 0 THEN 0.5 ELSE -0.4 END AS w, arg_min(x, vec_id) AS v FROM e GROUP BY label),
    s AS (SELECT vec_id, CAST(sum(w * exp(-{_KERNEL.gamma} * list_sum(list_transform(list_zip(x, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS DOUBLE) + {_KERNEL.intercept} AS score FROM e, sv GROUP BY vec_id)
    SELECT vec_id AS row_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 10 ELSE 0 END AS points FROM s""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    scaled = F.transform("features", lambda x: (x - _KERNEL.mean[0]) / _KERNEL.scale[0])
    support = rows.groupBy("label").agg(F.min_by(scaled, "row_id").alias("vector")).select(F.when(F.col("label") % 2 == 0, 0.5).otherwise(-0.4).alias("weight"), "vector")
    return kernel_scores(rows, support, _KERNEL).withColumn("score", F.round("score", 6))


_FEATURES = ["length", *[f"n_{name}" for name in CLASSES], "n_facing_cys"]

_ANCHORED = f"""g AS (SELECT CAST(record_id % 7 AS BIGINT) AS rec, record_id AS gene_id, record_id * 1000 AS s, record_id * 1000 + length(p) + 1 AS e, p FROM (SELECT record_id, {_PROTEIN} AS p FROM sequences)),
    h AS (SELECT CAST(doc_id % 7 AS BIGINT) AS rec, doc_id AS gene_id, unnest([lang, source]) AS profile FROM documents),
    a AS (SELECT gene_id FROM h GROUP BY gene_id HAVING bool_or(profile = 'de') OR (bool_or(profile = 'fr') AND bool_or(profile IN ('src1', 'src3')))),
    m AS (SELECT rec, s, e, p FROM g UNION ALL SELECT rec, s + 500, e + 500, reverse(p) FROM g)"""


@query("F26_anchored_detector", with_tables(f""", {_ANCHORED}, f AS (SELECT rec, s, e FROM m WHERE length(p) BETWEEN 20 AND 2000 AND regexp_matches(p, 'TH.{{1,3}}DE'))
    SELECT DISTINCT g.rec AS record_id, g.gene_id FROM g JOIN a USING (gene_id) JOIN f ON f.rec = g.rec AND g.s - 9000 <= f.s AND f.e <= g.e + 9000""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proteins(spark, folder)
    genes = rows.select((F.col("record_id") % 7).cast("long").alias("record_id"), F.col("record_id").alias("gene_id"), (F.col("record_id") * 1000).alias("start"), (F.col("record_id") * 1000 + F.length("seq") + 1).alias("end"), F.col("seq").alias("translation"))
    orfs = genes.select("record_id", "gene_id", (F.col("start") + 500).alias("start"), (F.col("end") + 500).alias("end"), F.reverse("translation").alias("translation"))
    hits = spark.read.parquet(f"{folder}/documents.parquet").select((F.col("doc_id") % 7).cast("long").alias("record_id"), F.col("doc_id").alias("gene_id"), F.explode(F.array("lang", "source")).alias("profile"))
    return ops.anchored_detector(genes, hits, orfs, ["de"], ["fr"], ["src1", "src3"], "TH.{1,3}DE", 9000, 20, 2000)


# Circular records: a user's events by the time of day.
_HALF_DAY = 43_200
_CYCLE = Rules((Rule("click", profile("click"), 6000, 4000, "c"), Rule("view", profile("view"), 9000, 14_000, "v"), Rule("error", profile("error"), 3000, 40_000, "e")))
_CYCLE_SQL = f""", core AS (SELECT record_id, gene_id, profile AS rule, "start" % {_HALF_DAY} AS "start", "start" % {_HALF_DAY} + "end" - "start" AS "end", CASE profile WHEN 'click' THEN 6000 WHEN 'view' THEN 9000 ELSE 3000 END AS cutoff, CASE profile WHEN 'click' THEN 4000 WHEN 'view' THEN 14000 ELSE 40000 END AS nb FROM moments WHERE profile IN ('click', 'view', 'error')),
    reached AS (SELECT *, max("end") OVER (PARTITION BY record_id, rule ORDER BY "start", "end", gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM core),
    marked AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach >= cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, rule ORDER BY "start", "end", gene_id ROWS UNBOUNDED PRECEDING) AS island FROM reached),
    spans AS (SELECT record_id, rule, island, min("start") AS low, max("end") AS high, count(*) AS n, any_value(cutoff) AS cutoff, any_value(nb) AS nb FROM marked GROUP BY ALL),
    placed AS (SELECT *, count(*) OVER (PARTITION BY record_id, rule) AS k, first_value(low) OVER w AS low0, last_value(high) OVER w AS high9 FROM spans WINDOW w AS (PARTITION BY record_id, rule ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    turned AS (SELECT *, k > 1 AND low0 + {_HALF_DAY} - high9 < cutoff AND island = 1 AS goes FROM placed),
    cores AS (SELECT record_id, rule AS product, CASE WHEN goes THEN k ELSE island END AS island, min(CASE WHEN goes THEN low + {_HALF_DAY} ELSE low END) AS core_start, max(CASE WHEN goes THEN high + {_HALF_DAY} ELSE high END) AS core_end, CAST(sum(n) AS BIGINT) AS n_genes, any_value(nb) AS nb FROM turned GROUP BY 1, 2, 3),
    wide AS (SELECT *, core_end - core_start + 2 * nb >= {_HALF_DAY} AS whole, CAST(floor((core_start + core_end - {_HALF_DAY}) / 2) AS BIGINT) AS middle, ((core_start - nb) % {_HALF_DAY} + {_HALF_DAY}) % {_HALF_DAY} AS low FROM cores),
    areas AS (SELECT record_id, product, core_start, core_end, n_genes, CASE WHEN whole AND core_end > {_HALF_DAY} THEN middle WHEN whole THEN 0 ELSE low END AS "start", CASE WHEN whole AND core_end > {_HALF_DAY} THEN middle + {_HALF_DAY} - 1 WHEN whole THEN {_HALF_DAY} ELSE low + core_end - core_start + 2 * nb END AS "end" FROM wide)"""


def _cycle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    moments = table(spark, folder, "moments")
    start = F.col("start") % _HALF_DAY
    cores = moments.select("record_id", "gene_id", F.col("profile").alias("rule"), start.alias("start"), (start + F.col("end") - F.col("start")).alias("end"), "score")
    lengths = moments.select("record_id").distinct().withColumns({"length": F.lit(_HALF_DAY).cast("long"), "circular": F.lit(True)})
    return cores, lengths


def _cycle_areas(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    genes, lengths = _cycle(spark, folder)
    cores = area_ops.chain_cores(genes, _CYCLE, lengths=lengths)
    return area_ops.expand(cores, lengths), genes, lengths


@query("F9_circular_cores", with_tables(f"{_CYCLE_SQL} SELECT record_id, product, core_start, core_end, n_genes FROM cores", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle_areas(spark, folder)[0].select("record_id", "product", "core_start", "core_end", "n_genes")


@query("F10_circular_expand", with_tables(f'{_CYCLE_SQL} SELECT record_id, product, "start", "end" FROM areas', "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle_areas(spark, folder)[0].select("record_id", "product", "start", "end")


@query("F11_circular_extend", with_tables(f"""{_CYCLE_SQL}, x AS (SELECT record_id, gene_id, "start" % {_HALF_DAY} AS "start", "start" % {_HALF_DAY} + "end" - "start" AS "end" FROM moments WHERE profile = 'signup' AND score > 40),
    xr AS (SELECT *, max("end") OVER (PARTITION BY record_id ORDER BY "start", "end", gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
    xm AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY "start", "end", gene_id ROWS UNBOUNDED PRECEDING) AS island FROM xr),
    xs AS (SELECT record_id, island, min("start") AS low, max("end") AS high, count(*) OVER (PARTITION BY record_id) AS k FROM xm GROUP BY record_id, island),
    xo AS (SELECT record_id, min(low) AS low0, max_by(high, island) AS high9 FROM xs GROUP BY record_id),
    xt AS (SELECT record_id, CASE WHEN goes THEN k ELSE island END AS island, min(CASE WHEN goes THEN low + {_HALF_DAY} ELSE low END) AS low, max(CASE WHEN goes THEN high + {_HALF_DAY} ELSE high END) AS high FROM (SELECT xs.*, k > 1 AND island = 1 AND low0 + {_HALF_DAY} - high9 <= 6000 AS goes FROM xs JOIN xo USING (record_id)) GROUP BY 1, 2),
    xx AS (SELECT record_id, low + d AS low, high + d AS high FROM xt, (VALUES (-{_HALF_DAY}), (0), ({_HALF_DAY})) v(d)),
    grown AS (SELECT c.record_id, c.product, c.n_genes, c.core_start, c.core_end, least(c.core_start, min(low)) AS a, greatest(c.core_end, max(high)) AS b FROM cores c LEFT JOIN xx ON product = 'click' AND xx.record_id = c.record_id AND low - core_end <= 6000 AND core_start - high <= 6000 GROUP BY c.record_id, c.product, c.n_genes, c.core_start, c.core_end)
    SELECT record_id, product, n_genes, CASE WHEN b - a >= {_HALF_DAY} THEN 0 ELSE ((a % {_HALF_DAY}) + {_HALF_DAY}) % {_HALF_DAY} END AS core_start, CASE WHEN b - a >= {_HALF_DAY} THEN {_HALF_DAY} ELSE ((a % {_HALF_DAY}) + {_HALF_DAY}) % {_HALF_DAY} + b - a END AS core_end FROM grown""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    cores, genes, lengths = _cycle_areas(spark, folder)
    extenders = genes.where("rule = 'signup' and score > 40").withColumn("rule", F.lit("click"))
    return area_ops.extend_cores(cores, extenders, 10_000, lengths).select("record_id", "product", "n_genes", "core_start", "core_end")


@query("F20_circular_regions", with_tables(f"""{_CYCLE_SQL}, s AS (SELECT record_id, product, "start", "end" FROM areas WHERE product = 'click'),
    r AS (SELECT *, max("end") OVER (PARTITION BY record_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    m AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
    g AS (SELECT record_id, island, min("start") AS low, max("end") AS high, count(*) AS n, count(*) OVER (PARTITION BY record_id) AS k FROM m GROUP BY record_id, island),
    e AS (SELECT record_id, min(low) AS low0, max_by(high, island) AS high9 FROM g GROUP BY record_id),
    t AS (SELECT record_id, CASE WHEN goes THEN k ELSE island END AS island, min(CASE WHEN goes THEN low + {_HALF_DAY} ELSE low END) AS "start", max(CASE WHEN goes THEN high + {_HALF_DAY} ELSE high END) AS "end", CAST(sum(n) AS BIGINT) AS n_areas FROM (SELECT g.*, k > 1 AND island = 1 AND low0 + {_HALF_DAY} < high9 AS goes FROM g JOIN e USING (record_id)) GROUP BY 1, 2)
    SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY "end" > {_HALF_DAY} DESC, "start") AS region, "start", "end", n_areas FROM t""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    areas, _, lengths = _cycle_areas(spark, folder)
    return area_ops.regions(areas.where("product = 'click'").select("record_id", "start", "end"), lengths=lengths)


#: The way round a circle: the least over turns of one row by whole lengths.
_ROUND = f"""circle AS (SELECT record_id, gene_id, profile, "start" % {_HALF_DAY} AS s, "start" % {_HALF_DAY} + "end" - "start" AS e FROM moments),
    apart AS (SELECT a.record_id, a.gene_id, a.profile, b.gene_id AS o_gene, b.profile AS o_profile, least(greatest(0, b.s - a.e, a.s - b.e), greatest(0, b.s + {_HALF_DAY} - a.e, a.s - b.e - {_HALF_DAY}), greatest(0, b.s - {_HALF_DAY} - a.e, a.s - b.e + {_HALF_DAY})) AS distance FROM circle a JOIN circle b USING (record_id))"""


@query("D2_circular_neighbours", with_tables(f", {_ROUND} SELECT record_id, gene_id AS a, o_gene AS b, distance FROM apart WHERE gene_id < o_gene AND distance < 9000", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes, lengths = _cycle(spark, folder)
    return join_ops.neighbours(genes, 9000, lengths)


@query("D3_circular_nearest", with_tables(f", {_ROUND} SELECT record_id, gene_id, coalesce(min(distance) FILTER (o_profile = 'signup' AND distance < 5000), -1) AS distance FROM apart GROUP BY ALL", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes, lengths = _cycle(spark, folder)
    return join_ops.nearest_with_profile(genes, genes.withColumnRenamed("rule", "profile"), ["signup"], 5000, lengths)


@query("D10_circular_areas", with_tables(f""", {_ROUND}, sized AS (SELECT c.*, e - s + 2 * (CASE WHEN profile = 'error' THEN 22000 ELSE 8000 END) AS size, CASE WHEN profile = 'error' THEN 22000 ELSE 8000 END AS pad FROM circle c)
    SELECT gene_id, record_id, CASE WHEN size >= {_HALF_DAY} THEN 0 WHEN s < pad THEN s - pad + {_HALF_DAY} ELSE s - pad END AS "start", CASE WHEN size >= {_HALF_DAY} THEN {_HALF_DAY} WHEN s < pad THEN s - pad + {_HALF_DAY} + size ELSE s - pad + size END AS "end" FROM sized""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes, lengths = _cycle(spark, folder)
    named = lambda condition, padding: join_ops.areas_by_gene(genes, genes.where(condition).select("gene_id"), lengths, padding)
    return named("rule <> 'error'", 8000).unionByName(named("rule = 'error'", 22_000))


@query("F7_circular_rules", with_tables(f""", {_ROUND}, wide AS (SELECT * FROM apart WHERE gene_id <> o_gene AND distance < {int(DAY * 0.1)}), tight AS (SELECT * FROM wide WHERE distance < {int(DAY // 2 * 0.1)}), {MATCHED_SQL}
    SELECT record_id, gene_id, rule, string_agg(profile, ',' ORDER BY profile) AS matches FROM matched GROUP BY ALL""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes, lengths = _cycle(spark, folder)
    return evaluate_rules(genes, genes.withColumnRenamed("rule", "profile"), RULES.scaled(0.1), lengths).withColumn("matches", F.array_join("matches", ","))


_SET = f"""{_REGIONS}, whole AS (SELECT *, 'r' || record_id AS accession, 'c' || "start" || '-' || "end" AS cluster, record_id * 1000000 + region AS rid FROM regions WHERE "start" >= 2000),
    members AS (SELECT w.rid, w.accession, w.cluster, g.*, CASE WHEN g.score > 80000 THEN 'no_locus_tag' ELSE 'g_' || g.gene_id END AS tag, CASE WHEN g.score < 20000 THEN 'no_accession' ELSE 'p' || g.gene_id END AS protein FROM whole w JOIN genes g ON g.record_id = w.record_id AND w."start" <= g."start" AND g."end" <= w."end")"""


#: Regions that begin before this are at an edge.
_EDGE = 2000


def _labelled(genes: DataFrame) -> DataFrame:
    return genes.withColumns({"locus_tag": F.when(F.col("score") <= 80000, F.concat(F.lit("g "), "gene_id")), "protein_id": F.when(F.col("score") >= 20000, F.concat(F.lit("p"), "gene_id"))})


def _annotated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    regions = area_ops.regions(plain_areas(spark, folder)).select("record_id", F.concat(F.lit("r"), "record_id").alias("accession"), F.lit("d").alias("description"), (F.col("record_id") * 1000000 + F.col("region")).alias("region"), "start", "end", F.lit("x").alias("products"), (F.col("start") < _EDGE).alias("at_edge"))
    inside = range_join(regions.select("record_id", "region", "start", "end"), table(spark, folder, "genes"), ["record_id"], 20000, how="contain").select(F.col("l.region").alias("region"), "r.*")
    return regions, inside


@query("A15_cluster_reference", with_tables(f"""{_SET} SELECT accession, cluster, string_agg(tag, ';' ORDER BY "start", "end", tag, protein) AS tags, string_agg(protein, ';' ORDER BY "start", "end", tag, protein) AS proteins FROM members GROUP BY rid, accession, cluster""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (genes := plain_regions(spark, folder, "score")) is not None:
        found = reference_sets.clusters_of(_labelled(genes), _EDGE)
        return found.select(F.concat(F.lit("r"), "record_id").alias("accession"), "cluster", "tags", "proteins")
    return reference_sets.build_cluster_reference(*_reference(spark, folder))[0].select("accession", "cluster", "tags", "proteins")


def _reference(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    regions, genes = _annotated(spark, folder)
    return regions, _labelled(genes).select("region", "start", "end", "strand", "locus_tag", F.col("profile").alias("annotation"), "protein_id", F.repeat(F.lit("MK"), 3).alias("translation"))


@query("A15_reference_proteins", with_tables(f"""{_SET} SELECT '>' || accession || '|' || cluster || '|' || ("start" + 1) || '-' || "end" || '|' || CASE WHEN strand = 1 THEN '+' ELSE '-' END || '|linearised' || ("start" + 1) || '-' || "end" || '|' || tag || '|' || profile || '|' || protein AS header, 'MKMKMK' AS seq FROM members""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return reference_sets.build_cluster_reference(*_reference(spark, folder))[1].select("header", "seq")


@query("A16_component_reference", with_tables(f"""{_SET}, told AS (SELECT gene_id, CASE CAST(floor(score) AS BIGINT) % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'transport' WHEN 2 THEN 'regulatory' ELSE 'other' END AS f, strand FROM genes),
    g AS (SELECT rid, m.record_id, m."start", m."end", gene_id, CASE WHEN CAST(floor(score) AS BIGINT) % 4 = 0 THEN 'core' WHEN CAST(floor(score) AS BIGINT) % 4 = 1 THEN 'transport' WHEN CAST(floor(score) AS BIGINT) % 4 = 2 AND strand = -1 THEN 'regulatory' ELSE 'other' END AS function, profile FROM members m)
    SELECT record_id, min("start") AS "start", max("end") AS "end", string_agg(function || ':' || profile, ',' ORDER BY "start", "end", record_id || ':' || gene_id) AS genes FROM g GROUP BY rid, record_id""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    regions, genes = _annotated(spark, folder)
    kind = F.floor("score") % 4
    named = F.concat_ws(":", F.col("record_id").cast("string"), F.col("gene_id").cast("string"))  # a gene's number may recur on other records
    genes = genes.withColumn("gene_id", named)
    rows = table(spark, folder, "genes").withColumn("gene_id", named).dropDuplicates(["gene_id"])
    functions = rows.select("gene_id", F.when(kind == 2, "rule-based-clusters").otherwise("smcogs").alias("tool"), F.when(kind == 0, "core").when(kind == 1, "transport").when((kind == 2) & (F.col("strand") == -1), "regulatory").otherwise("other").alias("function"), F.lit(1).alias("ord"))
    profiles = rows.select("gene_id", F.lit(1).alias("ord"), "profile")
    modules = rows.where("profile = 'RF'").select("gene_id", F.lit(0).alias("module"), F.array(F.lit("Condensation_LCL"), F.lit("PCP")).alias("domains"), F.lit("nrps").alias("kind"), F.lit(True).alias("complete"))
    found = reference_sets.build_component_reference(regions, genes.select("region", "gene_id", "start", "end"), functions, profiles, modules)
    text = F.array_join(F.transform("genes", lambda g: F.concat(g["function"], F.lit(":"), F.array_join(g["secmet"], "/"))), ",")
    return found.select("record_id", "start", "end", text.alias("genes"))


@query("A17_core_reference", with_tables(f""", m AS (SELECT record_id AS accession, CAST(gene_id AS VARCHAR) AS gene, profile AS kind, substr('{_ACIDS}', CAST("start" % 15 + 1 AS INT), CAST("end" % 3 + 3 AS INT)) AS core, ord FROM hits),
    n AS (SELECT *, row_number() OVER (PARTITION BY accession, gene ORDER BY ord) AS k, count(*) OVER (PARTITION BY accession, gene) AS of_ FROM m),
    c AS (SELECT accession, core, count(*) AS n, min(CASE WHEN of_ > 1 THEN gene || ' (core ' || k || ')' ELSE gene END) AS name, min(kind) AS kind, min(ord) AS ord FROM n GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY accession, ord, core) AS entry, accession, CASE WHEN n > 1 THEN 'multiple genes' ELSE name END AS gene, kind, core FROM c""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    core = F.substr(F.lit(_ACIDS), (F.col("start") % 15 + 1).cast("int"), (F.col("end") % 3 + 3).cast("int"))
    motifs = table(spark, folder, "hits").select(F.col("record_id").alias("accession"), F.col("gene_id").cast("string").alias("gene"), F.col("profile").alias("kind"), F.lower(core).alias("core"), "ord")
    return reference_sets.build_core_reference(motifs)

"""Queries on rules and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import areas as ops
from ..operators.rules import Condition, Rule, Rules, evaluate_rules, evaluated, gene, gene_profiles, min_score, minimum, profile, repeatable, strip_inferior
from ..plans.ordering import SMALL, small_keys
from ..registry import FLAGSHIP, query
from ..tables import table, with_tables

DAY = 86400
#: Rules on the time axis: who buys after a click, and mixed attention.
RULES = Rules((
    Rule("buy", profile("click") & profile("purchase"), DAY, 7200, "sale", superiors=("seen",)),
    Rule("seen", minimum(2, ["view", "signup"]), DAY // 2, 3600, "visit"),
    Rule("lost", profile("error") & ~profile("purchase"), DAY // 2, 3600, "fault"),
))


def _near(cutoff: int, name: str = "n") -> str:
    return f"""{name} AS (SELECT a.record_id, a.gene_id, a.profile, a.score, b.gene_id AS o_gene, b.profile AS o_profile, b.score AS o_score FROM moments a JOIN moments b
        ON a.record_id = b.record_id AND a.gene_id <> b.gene_id AND greatest(a."start" - b."end", b."start" - a."end") < {cutoff})"""


def _condition(condition: Condition, cutoff: int = DAY):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        moments = table(spark, folder, "moments")
        found = evaluated(gene_profiles(moments, moments), condition, cutoff)
        return found.select("record_id", "gene_id", "met", F.array_join("matches", ",").alias("matches"), "n_ancillary")

    return run


def _condition_sql(met: str, matches: str, ancillary: str, cutoff: int = DAY) -> str:
    """``o`` aggregates the neighbours of a gene; absent ones count 0."""
    return with_tables(f""", {_near(cutoff)}, o AS (SELECT record_id, gene_id, {", ".join(f"count(*) FILTER (o_profile = '{p}') AS {p}" for p in ("click", "view", "error", "purchase", "signup"))}, coalesce(max(o_score) FILTER (o_profile = 'click'), -1) AS click_score FROM n GROUP BY ALL),
    g AS (SELECT m.record_id, m.gene_id, m.profile, m.score, coalesce(click, 0) AS click, coalesce("view", 0) AS views, coalesce(error, 0) AS error, coalesce(purchase, 0) AS purchase, coalesce(signup, 0) AS signup, coalesce(click_score, -1) AS click_score FROM moments m LEFT JOIN o USING (record_id, gene_id))
    SELECT record_id, gene_id, {met} AS met, {matches} AS matches, CAST({ancillary} AS BIGINT) AS n_ancillary FROM g""", "moments")


query("F1_profile_condition", _condition_sql("profile = 'click' OR click > 0", "CASE WHEN profile = 'click' THEN 'click' ELSE '' END", "CASE WHEN profile = 'click' THEN 0 ELSE click END"))(_condition(profile("click")))
query("F2_boolean_condition", _condition_sql(
    "(profile IN ('click', 'view') OR click > 0 OR views > 0) AND NOT (profile = 'error' OR error > 0)", "CASE WHEN profile IN ('click', 'view', 'error') THEN profile ELSE '' END",
    "CASE WHEN profile = 'click' THEN 0 ELSE click END + CASE WHEN profile = 'view' THEN 0 ELSE views END + CASE WHEN profile = 'error' THEN 0 ELSE error END"))(_condition((profile("click") | profile("view")) & ~profile("error")))
query("F3_minimum_condition", _condition_sql(
    "(CASE WHEN profile = 'click' OR click > 0 THEN 1 ELSE 0 END + CASE WHEN profile = 'view' OR views > 0 THEN 1 ELSE 0 END + CASE WHEN profile = 'signup' OR signup > 0 THEN 1 ELSE 0 END) >= 2", "CASE WHEN profile IN ('click', 'view', 'signup') THEN profile ELSE '' END",
    "CASE WHEN (CASE WHEN profile = 'click' OR click > 0 THEN 1 ELSE 0 END + CASE WHEN profile = 'view' OR views > 0 THEN 1 ELSE 0 END + CASE WHEN profile = 'signup' OR signup > 0 THEN 1 ELSE 0 END) >= 2 THEN click + views + signup ELSE 0 END"))(_condition(minimum(2, ["click", "view", "signup"])))
query("F4_repeatable_condition", _condition_sql(
    "CASE WHEN profile IN ('click', 'view') THEN 1 ELSE 0 END + click + views >= 3", "CASE WHEN profile IN ('click', 'view') THEN profile ELSE '' END",
    "CASE WHEN CASE WHEN profile IN ('click', 'view') THEN 1 ELSE 0 END + click + views >= 3 THEN click + views ELSE 0 END"))(_condition(repeatable(3, ["click", "view"])))
query("F5_gene_condition", _condition_sql("profile IN ('click', 'view') OR click > 0 OR views > 0", "CASE WHEN profile IN ('click', 'view') THEN profile ELSE '' END", "0"))(_condition(gene((profile("click") | profile("view")) & ~profile("error"))))
query("F6_score_condition", _condition_sql("(profile = 'click' AND score >= 60) OR click_score >= 60", "CASE WHEN profile = 'click' AND score >= 60 THEN 'click' ELSE '' END", "0"))(_condition(min_score("click", 60)))


def _rules_sql(day: int) -> str:
    """CTE ``matched``: record, gene, rule, profile, distinct."""
    return f"""{_near(day, "wide")}, {_near(day // 2, "tight")}, {MATCHED_SQL}"""


#: The rules over the pairs of ``wide`` and of ``tight``.
MATCHED_SQL = """buy AS (SELECT * FROM wide WHERE (profile = 'click' AND o_profile = 'purchase') OR (profile = 'purchase' AND o_profile = 'click')),
    pair AS (SELECT DISTINCT record_id, gene_id FROM tight WHERE (profile = 'view' AND o_profile = 'signup') OR (profile = 'signup' AND o_profile = 'view')),
    lost AS (SELECT * FROM moments m WHERE profile = 'error' AND NOT EXISTS (SELECT 1 FROM tight t WHERE t.record_id = m.record_id AND t.gene_id = m.gene_id AND o_profile = 'purchase')),
    matched AS (SELECT record_id, gene_id, 'buy' AS rule, profile FROM buy UNION SELECT record_id, o_gene, 'buy', o_profile FROM buy
        UNION SELECT record_id, gene_id, 'seen', profile FROM moments WHERE (record_id, gene_id) IN (SELECT (record_id, gene_id) FROM pair)
        UNION SELECT t.record_id, o_gene, 'seen', o_profile FROM tight t JOIN pair USING (record_id, gene_id) WHERE o_profile IN ('view', 'signup')
        UNION SELECT record_id, gene_id, 'lost', profile FROM lost)"""


@query("F7_evaluate_rules", with_tables(f", {_rules_sql(DAY)} SELECT record_id, gene_id, rule, string_agg(profile, ',' ORDER BY profile) AS matches FROM matched GROUP BY ALL", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    return evaluate_rules(moments, moments, RULES).withColumn("matches", F.array_join("matches", ","))


@query("F8_scaled_rules", with_tables(f", {_rules_sql(DAY // 2)} SELECT rule, CAST(count(DISTINCT (record_id, gene_id)) AS BIGINT) AS n_genes FROM matched GROUP BY rule", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    return evaluate_rules(moments, moments, RULES.scaled(0.5, 2)).groupBy("rule").agg(F.count("*").alias("n_genes"))


@query("F14_strip_inferior", with_tables(f", {_rules_sql(DAY)} SELECT DISTINCT record_id, gene_id, rule FROM matched m WHERE NOT (rule = 'buy' AND EXISTS (SELECT 1 FROM matched s WHERE s.record_id = m.record_id AND s.gene_id = m.gene_id AND s.rule = 'seen'))", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    return strip_inferior(evaluate_rules(moments, moments, RULES), RULES).select("record_id", "gene_id", "rule")


def islands_sql(name: str, source: str, keys: str, gap: str, start: str = '"start"', end: str = '"end"', order: str = "gene_id", strict: bool = True) -> str:
    """CTE ``name``: the rows of ``source`` with ``island``."""
    return f"""{name}_r AS (SELECT *, max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end}, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {name} AS (SELECT * EXCLUDE (reach), sum(CASE WHEN reach IS NULL OR {start} - reach {">=" if strict else ">"} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {start}, {end}, {order} ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r)"""


_BY_DAY = f""", {_rules_sql(DAY)}, core AS (SELECT DISTINCT m.record_id, m.gene_id, rule, "start", "end" FROM matched m JOIN moments USING (record_id, gene_id)),
    {islands_sql("chained", "core", "record_id, rule", f"CASE rule WHEN 'buy' THEN {DAY} ELSE {DAY // 2} END")}
    SELECT record_id, rule AS product, greatest(0, min("start") - CASE rule WHEN 'buy' THEN 7200 ELSE 3600 END) AS "start", max("end") + CASE rule WHEN 'buy' THEN 7200 ELSE 3600 END AS "end", count(*) AS n_genes FROM chained GROUP BY record_id, rule, island"""


@query(FLAGSHIP, with_tables(_BY_DAY, "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    cores = evaluate_rules(moments, moments, RULES).join(moments.select("record_id", "gene_id", "start", "end"), ["record_id", "gene_id"])
    return ops.expand(ops.chain_cores(cores, RULES)).select("record_id", "product", "start", "end", "n_genes")


#: Rules on long records: one per profile, with the same distances.
_PROFILES = ("AF", "AO", "NF", "NO", "RF", "RO")
_PLAIN = Rules(tuple(Rule(p, profile(p), 1000, 500, p[0], superiors=("AF",) if p == "AO" else ()) for p in _PROFILES))
_LENGTHS = 'lengths AS (SELECT record_id, max("end") + 200 AS length FROM genes GROUP BY record_id)'
_CHAINED = f""", core AS (SELECT record_id, gene_id, profile AS rule, "start", "end" FROM genes), {islands_sql("chained", "core", "record_id, rule", "1000")},
    cores AS (SELECT record_id, rule AS product, min("start") AS core_start, max("end") AS core_end, count(*) AS n_genes, min(("start", "end", gene_id)) AS f, max(("start", "end", gene_id)) AS l FROM chained GROUP BY record_id, rule, island)"""


def _core_genes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "genes").select("record_id", "gene_id", F.col("profile").alias("rule"), "start", "end")


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "genes").groupBy("record_id").agg((F.max("end") + 200).alias("length"))


@query("F9_chain_cores", with_tables(f"{_CHAINED} SELECT record_id, product, core_start, core_end, n_genes FROM cores", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.chain_cores(_core_genes(spark, folder), _PLAIN).select("record_id", "product", "core_start", "core_end", "n_genes")


@query("F9_chain_cores_spread", with_tables(f"{_CHAINED} SELECT record_id, product, core_start, core_end, n_genes FROM cores", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The plan for records of any size: every key dealt over range partitions, with totals carried from one to the next."""
    return ops.chain_cores(_core_genes(spark, folder), _PLAIN, most=0).select("record_id", "product", "core_start", "core_end", "n_genes")


@query("F10_expand", with_tables(f'{_CHAINED}, {_LENGTHS} SELECT record_id, product, core_start, core_end, greatest(0, core_start - 500) AS "start", least(length, core_end + 500) AS "end" FROM cores JOIN lengths USING (record_id)', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.expand(ops.chain_cores(_core_genes(spark, folder), _PLAIN), _lengths(spark, folder)).select("record_id", "product", "core_start", "core_end", "start", "end")


@query("F11_extend_cores", with_tables(f"""{_CHAINED}, x AS (SELECT record_id, 'AF' AS product, gene_id, "start", "end" FROM genes WHERE profile IN ('NO', 'RF') AND score > 30000),
    {islands_sql("xi", "x", "record_id, product", "1000", strict=False)}, g AS (SELECT record_id, product, min("start") AS low, max("end") AS high FROM xi GROUP BY record_id, product, island)
    SELECT c.record_id, c.product, least(c.core_start, min(low)) AS core_start, greatest(c.core_end, max(high)) AS core_end, c.n_genes FROM cores c LEFT JOIN g ON g.record_id = c.record_id AND g.product = c.product AND low - core_end <= 1000 AND core_start - high <= 1000
    GROUP BY c.record_id, c.product, c.core_start, c.core_end, c.n_genes""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    extenders = table(spark, folder, "genes").where("profile in ('NO', 'RF') and score > 30000").select("record_id", "gene_id", F.lit("AF").alias("rule"), "start", "end")
    return ops.extend_cores(ops.chain_cores(_core_genes(spark, folder), _PLAIN), extenders).select("record_id", "product", "core_start", "core_end", "n_genes")


_INFERIOR = """left_over AS (SELECT * FROM cores c WHERE NOT (product = 'AO' AND EXISTS (SELECT 1 FROM cores o WHERE o.record_id = c.record_id AND o.product = 'AF' AND ((o.core_start <= c.core_start AND c.core_end <= o.core_end) OR (o.l >= c.f AND c.l >= o.f)))))"""


@query("F12_drop_inferior", with_tables(f"{_CHAINED}, {_INFERIOR} SELECT record_id, product, core_start, core_end FROM left_over", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.drop_inferior(ops.chain_cores(_core_genes(spark, folder), _PLAIN), _PLAIN).select("record_id", "product", "core_start", "core_end")


@query("F13_merge_same_type", with_tables(f"{_CHAINED}, {islands_sql('m', 'cores', 'record_id, product', '3000', 'core_start', 'core_end', 'n_genes')} SELECT record_id, product, min(core_start) AS core_start, max(core_end) AS core_end, CAST(sum(n_genes) AS BIGINT) AS n_genes FROM m GROUP BY record_id, product, island", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    cores = ops.chain_cores(_core_genes(spark, folder), _PLAIN).withColumn("cutoff", F.lit(3000).cast("long"))
    return ops.merge_same_type(cores).select("record_id", "product", "core_start", "core_end", "n_genes")


_AREAS_SQL = f"""{_CHAINED}, {_LENGTHS}, areas AS (SELECT record_id, product, greatest(0, core_start - 500) AS "start", least(length, core_end + 500) AS "end", core_start, core_end, substr(product, 1, 1) AS category,
    CAST(row_number() OVER (PARTITION BY record_id ORDER BY greatest(0, core_start - 500), least(length, core_end + 500), product) AS INT) AS area_id FROM cores JOIN lengths USING (record_id))"""


def plain_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of one product per profile on long records."""
    return ops.numbered(ops.expand(ops.chain_cores(_core_genes(spark, folder), _PLAIN), _lengths(spark, folder)))


def plain_regions(spark: SparkSession, folder: str, *columns: str) -> DataFrame | None:
    """The genes of ``plain_areas`` with areas and regions, dealt by record once, and further columns of genes; none where the records do not allow it."""
    genes = table(spark, folder, "genes").select("record_id", "gene_id", F.col("profile").alias("rule"), "start", "end", *columns)
    return ops.record_regions(genes, _PLAIN, 200) if ops.plain_records(genes, _PLAIN) else None


@query("F15_annotate_roles", with_tables(f"""{_AREAS_SQL} SELECT a.record_id, area_id, g.gene_id, g.profile, CASE WHEN g.profile = product AND g.score > 20000 THEN 'CORE' ELSE 'ADDITIONAL' END AS role
    FROM areas a JOIN genes g ON a.record_id = g.record_id AND a."start" <= g."start" AND g."end" <= a."end" """, "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes = table(spark, folder, "genes")
    matches = genes.where("score > 20000").select("record_id", "gene_id", F.col("profile").alias("rule"), F.array("profile").alias("matches"))
    return ops.annotate_roles(plain_areas(spark, folder), matches, genes, genes, 4000)


_LETTERS = Rules(tuple(Rule(p, profile(p), 400, 600) for p in ("A", "N", "R", "F", "O")))
_LETTER_SQL = f""", core AS (SELECT record_id, gene_id, unnest([substr(profile, 1, 1), substr(profile, 2, 1)]) AS rule, "start", "end" FROM genes), {islands_sql("chained", "core", "record_id, rule", "400")},
    named AS (SELECT record_id, rule, island, min("start") AS core_start, max("end") AS core_end, greatest(0, min("start") - 600) AS "start", max("end") + 600 AS "end" FROM chained GROUP BY record_id, rule, island),
    areas AS (SELECT *, record_id * 4294967296 + row_number() OVER (PARTITION BY record_id ORDER BY "start", "end", rule) AS id FROM named),
    defining AS (SELECT id, c.record_id, gene_id FROM chained c JOIN areas a ON a.record_id = c.record_id AND a.rule = c.rule AND a.island = c.island),
    pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM defining a JOIN defining b ON a.record_id = b.record_id AND a.gene_id = b.gene_id AND a.id <> b.id),
    reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
    comp AS (SELECT a AS area, least(a, min(b)) AS group_id FROM reach GROUP BY a),
    spans AS (SELECT record_id, group_id, min(core_start) AS s, max(core_end) AS e FROM comp JOIN areas ON id = area GROUP BY record_id, group_id),
    hybrid AS (SELECT area, group_id FROM comp UNION ALL SELECT id, group_id FROM areas a JOIN spans s ON s.record_id = a.record_id AND s.s <= core_start AND core_end <= s.e WHERE id NOT IN (SELECT area FROM comp))"""


def _span_groups_sql(name: str, members: str, low: str, high: str) -> str:
    return f"""{name}_u AS (SELECT record_id, 'g' || group_id AS unit, min({low}) AS low, max({high}) AS high, list(DISTINCT area) AS areas FROM {members} JOIN areas ON id = area GROUP BY record_id, group_id
        UNION ALL SELECT record_id, 'a' || id, {low}, {high}, [id] FROM areas WHERE id NOT IN (SELECT area FROM {members})), {islands_sql(name + "_i", name + "_u", "record_id", "0", "low", "high", "unit")},
    {name}_l AS (SELECT list_distinct(flatten(list(areas))) AS areas FROM {name}_i GROUP BY record_id, island HAVING count(*) > 1),
    {name} AS (SELECT list_min(areas) AS group_id, unnest(areas) AS area FROM {name}_l)"""


_STRONG = f"""{_LETTER_SQL}, {_span_groups_sql("interleaved", "hybrid", "core_start", "core_end")}, strong AS (SELECT area, group_id FROM interleaved UNION ALL SELECT area, group_id FROM hybrid WHERE area NOT IN (SELECT area FROM interleaved))"""
_ALL_GROUPS = f"""{_STRONG}, {_span_groups_sql("neighbouring", "strong", '"start"', '"end"')}"""


def lettered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Areas of one product per letter of the profiles, so that a gene defines two, and their defining genes."""
    genes = table(spark, folder, "genes")
    cores = genes.select("record_id", "gene_id", F.explode(F.array(F.substring("profile", 1, 1), F.substring("profile", 2, 1))).alias("rule"), "start", "end")
    chained = ops.islands(cores, ["record_id", "rule"], gap=400, order=["gene_id"])
    spans = chained.groupBy("record_id", F.col("rule").alias("product"), "island").agg(F.min("start").alias("core_start"), F.max("end").alias("core_end"))
    spans = spans.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("core_start") - 600), "end": F.col("core_end") + 600})
    areas = ops.numbered(spans).withColumn("id", F.col("record_id") * (1 << 32) + F.col("area_id"))
    defining = chained.withColumnRenamed("rule", "product").join(areas.select("record_id", "product", "island", "id"), ["record_id", "product", "island"]).select("id", "record_id", "gene_id")
    return areas, defining


def lettered_members(spark: SparkSession, folder: str) -> DataFrame | None:
    """The areas of ``lettered`` in hybrid groups, by windows over records; none where a record has too many genes for that."""
    genes = table(spark, folder, "genes").select("record_id", "gene_id", "profile", "start", "end")
    if not small_keys(genes, ["record_id"], SMALL // 2):
        return None
    cores = genes.repartition("record_id").select("record_id", "gene_id", F.explode(F.array(F.substring("profile", 1, 1), F.substring("profile", 2, 1))).alias("rule"), "start", "end")
    chained = ops.islands(cores, ["record_id", "rule"], gap=400, order=["gene_id"], spread=False)
    of_area = Window.partitionBy("record_id", "rule", "island")
    spans = chained.withColumns({"core_start": F.min("start").over(of_area), "core_end": F.max("end").over(of_area)})
    spans = spans.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("core_start") - 600), "end": F.col("core_end") + 600})
    place = F.dense_rank().over(Window.partitionBy("record_id").orderBy("start", "end", "rule"))
    return ops.hybrid_members(spans.withColumn("id", F.col("record_id") * (1 << 32) + place), 4000)


@query("F16_hybrid_groups", with_tables(f"{_LETTER_SQL} SELECT group_id, area FROM hybrid", "genes", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (members := lettered_members(spark, folder)) is not None:
        return members.where("hybrid is not null").select(F.col("id").alias("area"), F.col("hybrid").alias("group_id"))
    areas, defining = lettered(spark, folder)
    return ops.hybrid_groups(areas, defining, 4000)


@query("F17_interleaved_groups", with_tables(f"{_STRONG} SELECT group_id, area FROM interleaved", "genes", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (members := lettered_members(spark, folder)) is not None:
        return ops.distinct_members(ops.strong_members(members), "interleaved")
    areas, defining = lettered(spark, folder)
    return ops.interleaved_groups(areas, ops.hybrid_groups(areas, defining, 4000), 4000)


@query("F18_neighbouring_groups", with_tables(f"{_ALL_GROUPS} SELECT group_id, area FROM neighbouring", "genes", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (members := lettered_members(spark, folder)) is not None:
        return ops.distinct_members(ops.neighbour_members(members), "neighbouring")
    areas, defining = lettered(spark, folder)
    hybrid = ops.hybrid_groups(areas, defining, 4000)
    interleaved = ops.interleaved_groups(areas, hybrid, 4000)
    return ops.neighbouring_groups(areas, interleaved.unionByName(hybrid.join(interleaved.select("area"), "area", "left_anti")), 4000)


@query("F19_candidates", with_tables(f"""{_ALL_GROUPS}, every AS (SELECT 0 AS rank, * FROM hybrid UNION ALL SELECT 1, area, group_id FROM interleaved UNION ALL SELECT 2, area, group_id FROM neighbouring),
    built AS (SELECT rank, record_id, group_id, min("start") AS s, max("end") AS e, list(DISTINCT area) AS areas FROM every JOIN areas ON id = area GROUP BY ALL),
    merged AS (SELECT record_id, s, e, min(rank) AS rank, arg_min(areas, rank) AS first, list_distinct(flatten(list(areas))) AS areas FROM built GROUP BY ALL),
    extra AS (SELECT unnest(list_filter(areas, lambda x: NOT list_contains(first, x))) AS area FROM merged UNION SELECT id FROM areas WHERE id NOT IN (SELECT area FROM strong)),
    single AS (SELECT record_id, "start" AS s, "end" AS e, 3 AS rank, [id] AS areas FROM areas a WHERE id IN (SELECT area FROM extra) AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.record_id = a.record_id AND m.s = a."start" AND m.e = a."end" AND list_contains(m.areas, a.id)))
    SELECT record_id, ['chemical_hybrid', 'interleaved', 'neighbouring', 'single'][rank + 1] AS kind, s AS "start", e AS "end", array_to_string(list_sort(areas), ',') AS areas FROM (SELECT record_id, s, e, rank, areas FROM merged UNION ALL SELECT record_id, s, e, rank, areas FROM single)""", "genes", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    members = lettered_members(spark, folder)
    found = ops.candidates(*lettered(spark, folder), 4000) if members is None else ops.candidate_rows(members)
    return found.withColumn("areas", F.array_join(F.col("areas").cast("array<string>"), ","))


_REGIONS = f"""{_AREAS_SQL}, {islands_sql("ri", "areas", "record_id", "0", order="product")}, regions AS (SELECT record_id, CAST(island AS BIGINT) AS region, min("start") AS "start", max("end") AS "end", count(*) AS n_areas FROM ri GROUP BY record_id, island)"""


@query("F20_regions", with_tables(f"{_REGIONS} SELECT * FROM regions", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (genes := plain_regions(spark, folder)) is not None:
        return genes.groupBy("record_id", "region").agg(F.min("area_start").alias("start"), F.max("area_end").alias("end"), F.count("area_start").alias("n_areas"))
    return ops.regions(plain_areas(spark, folder))


@query("F21_region_summary", with_tables(f"""{_REGIONS}, inside AS (SELECT r.record_id, region, r."start", r."end", a."start" AS s, a."end" AS e, product, category FROM regions r JOIN areas a ON a.record_id = r.record_id AND r."start" <= a."start" AND a."end" <= r."end"),
    firsts AS (SELECT record_id, region, product, min((s, e, product, category)) AS place FROM inside GROUP BY ALL)
    SELECT i.record_id, i.region, i."start", i."end", (SELECT string_agg(product, '-' ORDER BY place) FROM firsts f WHERE f.record_id = i.record_id AND f.region = i.region) AS products,
    string_agg(DISTINCT category, ',' ORDER BY category) AS categories, CAST(count(*) AS INT) AS n_areas, i."start" <= 0 OR i."end" >= any_value(length) AS at_edge FROM inside i JOIN lengths USING (record_id) GROUP BY i.record_id, i.region, i."start", i."end" """, "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (genes := plain_regions(spark, folder)) is not None:
        return ops.region_summary_of(genes)
    areas = plain_areas(spark, folder)
    return ops.region_summary(ops.regions(areas), areas, _lengths(spark, folder), 20000)


@query("F22_sideload", with_tables(f""", {_LENGTHS} SELECT record_id, 'sub' AS kind, profile AS label, "start", "end", "start" AS core_start, "end" AS core_end FROM genes WHERE profile NOT LIKE 'R%'
    UNION ALL SELECT record_id, 'proto', profile, greatest(0, "start" - 700), least(length, "end" + 300), "start", "end" FROM genes JOIN lengths USING (record_id) WHERE profile LIKE 'R%'""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes = table(spark, folder, "genes").withColumnRenamed("profile", "label")
    subs = genes.where("label not like 'R%'").select("record_id", "label", "start", "end")
    cores = genes.where("label like 'R%'").select("record_id", "label", F.col("start").alias("core_start"), F.col("end").alias("core_end"), F.lit(700).alias("left"), F.lit(300).alias("right"))
    return ops.sideload(subs, cores, _lengths(spark, folder))


_LANES = """ranked AS (SELECT record_id, region, a."start", a."end", area_id, row_number() OVER (PARTITION BY record_id, region ORDER BY a."start", a."end", area_id) AS rn FROM regions r JOIN areas a USING (record_id) WHERE r."start" <= a."start" AND a."end" <= r."end"),
    walk AS (SELECT record_id, region, 1 AS step, ["end"] AS lanes, 0 AS lane, area_id FROM ranked WHERE rn = 1
        UNION ALL SELECT w.record_id, w.region, step + 1, CASE WHEN f IS NULL THEN list_append(lanes, x."end") ELSE list_concat(lanes[:f - 1], [x."end"], lanes[f + 1:]) END, CAST(coalesce(f - 1, len(lanes)) AS INT), x.area_id
        FROM walk w JOIN (SELECT * FROM ranked) x ON x.record_id = w.record_id AND x.region = w.region AND x.rn = w.step + 1, LATERAL (SELECT list_min(list_filter(range(1, len(w.lanes) + 1), lambda k: w.lanes[k] <= x."start")) AS f))"""


@query("F23_pack_lanes", with_tables(f"{_REGIONS}, {_LANES} SELECT record_id, region, area_id, lane FROM walk", "genes", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (genes := plain_regions(spark, folder)) is not None:
        return ops.pack_lanes(genes.where("area_id is not null").select("record_id", "region", "area_id", F.col("area_start").alias("start"), F.col("area_end").alias("end"))).select("record_id", "region", "area_id", "lane")
    areas = plain_areas(spark, folder)
    placed = ops.range_join(ops.regions(areas), areas.select("record_id", "area_id", "start", "end"), ["record_id"], 20000, how="contain")
    return ops.pack_lanes(placed.select("record_id", F.col("l.region").alias("region"), F.col("r.area_id").alias("area_id"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))).select("record_id", "region", "area_id", "lane")

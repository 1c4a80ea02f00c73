"""Queries on comparison with reference areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare as ops
from ..registry import query
from ..tables import table, with_tables

_SIZES = "sizes AS (SELECT ref_area, count(DISTINCT ref_gene) AS n_genes FROM alignments GROUP BY ref_area)"


def _alignments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "alignments")


def _sizes(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("ref_area").agg(F.countDistinct("ref_gene").alias("n_genes"))


for _name, _low, _high, _inclusive in (("general", 10, 30, False), ("known", 40, 45, False), ("sub", 20, 20, False), ("component", 25, 30, True)):
    _test = f"identity >= {_high} AND coverage >= {_low}" if _inclusive else f"floor(identity + 0.5) > {_high} AND coverage > {_low}"

    @query(f"G1_threshold_{_name}", with_tables(f"SELECT query_id, ref_gene, ord FROM alignments WHERE {_test}", "alignments"))
    def _(spark: SparkSession, folder: str, bounds=(_low, _high, _inclusive)) -> DataFrame:
        return ops.threshold_hits(_alignments(spark, folder), *bounds).select("query_id", "ref_gene", "ord")


_STATS = f""", {_SIZES}, stats AS (SELECT region, ref_area, count(DISTINCT query_id) AS hits, count(DISTINCT ref_gene) AS subjects, count(DISTINCT CASE WHEN query_id % 3 = 0 THEN query_id END) AS core_hits, round(sum(score), 2) AS score FROM alignments GROUP BY ALL)"""


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder)
    return ops.score_references(rows, rows.where("query_id % 3 = 0"), _sizes(rows)).withColumn("score", F.round("score", 2))


@query("G2_score_references", with_tables(f"{_STATS} SELECT region, ref_area, hits, subjects, core_hits, score, n_genes, CAST(100 * subjects // n_genes AS BIGINT) AS similarity FROM stats JOIN sizes USING (ref_area)", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder)


#: Distinct pairs of a region and reference, with dense query places.
_PAIRS = """pairs AS (SELECT region, ref_area, dense_rank() OVER (PARTITION BY region, ref_area ORDER BY query_id) AS query_idx, ref_idx % 6 AS ref_idx, query_id % 4 = 0 AS core, min(ord) AS place FROM alignments GROUP BY region, ref_area, query_id, ref_idx % 6, query_id % 4 = 0)"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder).groupBy("region", "ref_area", "query_id", (F.col("ref_idx") % 6).alias("ref_idx")).agg(F.min("ord").alias("place"))
    w = Window.partitionBy("region", "ref_area").orderBy("query_id")
    return rows.select("region", "ref_area", F.dense_rank().over(w).alias("query_idx"), "ref_idx", (F.col("query_id") % 4 == 0).alias("core"), "place")


@query("G3_synteny", with_tables(f""", {_PAIRS}, stepped AS (SELECT *, lead(query_idx) OVER w AS nq, lead(ref_idx) OVER w AS nr, lead(core) OVER w AS nc FROM pairs WINDOW w AS (PARTITION BY region, ref_area ORDER BY place)),
    able AS (SELECT *, CASE WHEN core OR nc THEN 2 ELSE 1 END AS worth, row_number() OVER (PARTITION BY region, ref_area ORDER BY place) AS rn FROM stepped s WHERE nq IS NOT NULL AND abs(query_idx - nq) < 2 AND abs(query_idx - nq) = abs(ref_idx - nr)
        AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.region = s.region AND p.ref_area = s.ref_area AND p.query_idx = s.nq AND p.ref_idx = s.ref_idx)),
    walk AS (SELECT region, ref_area, 1 AS step, [query_idx] AS qs, [ref_idx] AS rs, worth AS total FROM able WHERE rn = 1
        UNION ALL SELECT w.region, w.ref_area, step + 1, CASE WHEN list_contains(qs, query_idx) OR list_contains(rs, ref_idx) THEN qs ELSE list_append(qs, query_idx) END, CASE WHEN list_contains(qs, query_idx) OR list_contains(rs, ref_idx) THEN rs ELSE list_append(rs, ref_idx) END,
            total + CASE WHEN list_contains(qs, query_idx) OR list_contains(rs, ref_idx) THEN 0 ELSE worth END FROM walk w JOIN able a ON a.region = w.region AND a.ref_area = w.ref_area AND a.rn = w.step + 1)
    SELECT region, ref_area, CAST(max(total) AS BIGINT) AS synteny FROM walk GROUP BY ALL""", "alignments", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.synteny(_pairs(spark, folder))


@query("G4_rank_references", with_tables(f"""{_STATS}, t AS (SELECT *, hits + core_hits + CASE WHEN core_hits > 0 THEN 3 ELSE 0 END AS total FROM stats JOIN sizes USING (ref_area) WHERE n_genes = 1 OR (hits >= 2 AND subjects >= 2))
    SELECT region, ref_area, total, CAST(row_number() OVER (PARTITION BY region ORDER BY total DESC, score DESC, ref_area) AS INT) AS rank, count(*) OVER (PARTITION BY region) AS n_references FROM t QUALIFY rank <= 20""", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.rank_references(_stats(spark, folder).withColumn("synteny", F.lit(None).cast("long")), 20).select("region", "ref_area", F.col("total").cast("long"), "rank", "n_references")


_NAMED = "'acc_c' || ref_area || '_' || ref_idx"


@query("G5_homology_table", with_tables(f"SELECT region, query_id, string_agg(DISTINCT {_NAMED}, ',' ORDER BY {_NAMED}) AS names FROM alignments GROUP BY ALL", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    named = _alignments(spark, folder).withColumn("ref_name", F.expr(_NAMED))
    return ops.homology_table(named).select("region", "query_id", F.array_join("names", ",").alias("names"))


@query("G6_linked_groups", with_tables("""
    , e AS (SELECT DISTINCT region, query_id AS q, ref_gene AS s FROM alignments),
    cc(region, q, c) USING KEY (region, q) AS (SELECT DISTINCT region, q, q AS c FROM e
        UNION SELECT e.region, e.q, min(t.low) FROM e JOIN (SELECT e.region, e.s, min(r.c) AS low FROM e JOIN recurring.cc r ON r.region = e.region AND r.q = e.q GROUP BY ALL) t ON t.region = e.region AND t.s = e.s
            JOIN recurring.cc o ON o.region = e.region AND o.q = e.q GROUP BY e.region, e.q HAVING min(t.low) < min(o.c))
    SELECT region, q AS query_id, c AS group_id FROM cc""", "alignments", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.linked_groups(_alignments(spark, folder))


@query("G7_genes_of_interest", with_tables("SELECT DISTINCT ref_gene FROM alignments WHERE ref_area IN (SELECT ref_area FROM alignments WHERE score > 104000)", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder)
    return ops.genes_of_interest(rows.where("score > 104000"), rows)


_IDENTITY = """identity AS (SELECT region, ref_area, CASE WHEN m > 1 - 1e-8 THEN 1.0 WHEN m < 1e-8 THEN 0.0 ELSE least(1.0, greatest(0.0, ln(m / (1 - m)) / 12 + 0.5)) END AS identity_score FROM (SELECT region, ref_area, avg(identity) / 100 AS m FROM alignments GROUP BY ALL))"""


@query("G8_identity_score", with_tables(f", {_IDENTITY} SELECT region, ref_area, round(identity_score, 6) AS identity_score FROM identity", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.identity_score(_alignments(spark, folder)).withColumn("identity_score", F.round("identity_score", 6))


#: One reference per query: the best of the alignments, with places and strands.
_SINGLE = """single AS (SELECT region, ref_area, row_number() OVER (PARTITION BY region, ref_area ORDER BY query_id) AS query_idx, ref_idx % 8 AS ref_idx, query_id % 5 <> 0 AS same_strand FROM (SELECT * FROM alignments QUALIFY row_number() OVER (PARTITION BY region, ref_area, query_id ORDER BY ord) = 1))"""


def _single(spark: SparkSession, folder: str) -> DataFrame:
    best = _alignments(spark, folder).withColumn("_n", F.row_number().over(Window.partitionBy("region", "ref_area", "query_id").orderBy("ord"))).where("_n = 1")
    w = Window.partitionBy("region", "ref_area").orderBy("query_id")
    return best.select("region", "ref_area", F.row_number().over(w).alias("query_idx"), (F.col("ref_idx") % 8).alias("ref_idx"), (F.col("query_id") % 5 != 0).alias("same_strand"))


@query("G9_order_score", with_tables(f""", {_SINGLE}, b AS (SELECT *, CASE WHEN lag(same_strand) OVER w <> same_strand OR query_idx <> lag(query_idx) OVER w + 1 OR abs(ref_idx - lag(ref_idx) OVER w) <> 1 THEN 1 ELSE 0 END AS brk FROM single WINDOW w AS (PARTITION BY region, ref_area ORDER BY query_idx, ref_idx)),
    c AS (SELECT *, sum(brk) OVER (PARTITION BY region, ref_area ORDER BY query_idx, ref_idx ROWS UNBOUNDED PRECEDING) AS seg FROM b),
    s AS (SELECT region, ref_area, seg, count(*) AS n, min(query_idx) AS q1, max(query_idx) AS q2, arg_min(ref_idx, query_idx) AS r1, arg_max(ref_idx, query_idx) AS r2, bool_and(same_strand) AS same FROM c GROUP BY ALL),
    z AS (SELECT region, ref_area, max(query_idx) + 2 AS qs, 12 AS rs FROM single GROUP BY ALL),
    f AS (SELECT s.*, qs, rs, CASE WHEN lag(r1) OVER w IS NULL THEN 1.0 ELSE 0.5 + 0.5 * (1 - greatest((q1 - lag(q2) OVER w) / qs, CASE WHEN lag(r1) OVER w < r1 THEN least(r1, r2) - greatest(lag(r1) OVER w, lag(r2) OVER w) ELSE least(lag(r1) OVER w, lag(r2) OVER w) - greatest(r1, r2) END / rs)) END AS factor FROM s JOIN z USING (region, ref_area) WINDOW w AS (PARTITION BY region, ref_area ORDER BY seg)),
    g AS (SELECT region, ref_area, qs, rs, sum(n) AS hits, count(*) AS segs, count(*) FILTER (NOT same) AS rev, product(factor) AS factors FROM f GROUP BY ALL)
    SELECT region, ref_area, round(pow(pow(1.25, 1 / (0.2 * least(qs, rs))), hits - least(qs, rs)) * factors * pow(0.9, least(rev, segs - rev)) * CASE WHEN hits = 1 AND rs > 1 THEN 0.75 ELSE 1 END, 6) AS order_score FROM g""", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _single(spark, folder)
    sizes = pairs.groupBy("region", "ref_area").agg((F.max("query_idx") + 2).alias("query_size")).withColumn("ref_size", F.lit(12))
    return ops.order_score(pairs, sizes).withColumn("order_score", F.round("order_score", 6))


_PARTS = """q AS (SELECT region, kind, value, count(*) AS n FROM (SELECT region, unnest([{'kind': 'function', 'value': CASE query_id % 4 WHEN 0 THEN 'other' ELSE 'f' || query_id % 4 END}, {'kind': 'profile', 'value': 'p' || query_id % 30}], recursive := true) FROM alignments) WHERE NOT (kind = 'function' AND value = 'other') GROUP BY ALL),
    r AS (SELECT ref_area, kind, value, count(*) AS n FROM (SELECT ref_area, unnest([{'kind': 'function', 'value': CASE ref_gene % 4 WHEN 0 THEN 'other' ELSE 'f' || ref_gene % 4 END}, {'kind': 'profile', 'value': 'p' || ref_gene % 30}], recursive := true) FROM alignments) WHERE NOT (kind = 'function' AND value = 'other') GROUP BY ALL)"""


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def kinds(df: DataFrame, key: str, gene: str) -> DataFrame:
        function = F.when(F.col(gene) % 4 == 0, "other").otherwise(F.concat(F.lit("f"), F.col(gene) % 4))
        both = F.array(F.struct(F.lit("function").alias("kind"), function.alias("value")), F.struct(F.lit("profile").alias("kind"), F.concat(F.lit("p"), F.col(gene) % 30).alias("value")))
        return ops.components_of(df.select(key, F.inline(both)), [key])

    rows = _alignments(spark, folder)
    return kinds(rows, "region", "query_id"), kinds(rows, "ref_area", "ref_gene")


@query("G10_components", with_tables(f", {_PARTS} SELECT * FROM q", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder)[0]


for _mode, _most in (("reference_in_query", "rn"), ("query_in_reference", "qn"), ("best", "qn")):

    @query(f"G11_component_score_{_mode}", with_tables(f""", {_PARTS}, qs AS (SELECT region, kind, sum(n) AS qn FROM q GROUP BY ALL), rs AS (SELECT ref_area, kind, sum(n) AS rn FROM r GROUP BY ALL)
        SELECT region, ref_area, q.kind AS kind, round(sum(least(q.n, r.n)) / any_value({_most}), 6) AS component_score FROM q JOIN r ON q.kind = r.kind AND q.value = r.value JOIN qs USING (region) JOIN rs USING (ref_area) WHERE qs.kind = q.kind AND rs.kind = q.kind GROUP BY region, ref_area, q.kind""", "alignments"))
    def _(spark: SparkSession, folder: str, mode=_mode) -> DataFrame:
        return ops.component_score(*_parts(spark, folder), mode).withColumn("component_score", F.round("component_score", 6))


#: Metrics per pair of areas, of which one may be missing.
_METRICS = """metrics AS (SELECT region, ref_area, round(avg(identity) / 100, 6) AS m1, round(max(coverage) / 100, 6) AS m2, CASE WHEN ref_area % 3 > 0 THEN round(count(DISTINCT query_id) / count(*), 6) END AS m3 FROM alignments GROUP BY {keys}),
    final AS (SELECT *, round(pow(m1 * m2 * coalesce(m3, 1), 1.0 / (2 + CASE WHEN m3 IS NULL THEN 0 ELSE 1 END)), 6) AS final FROM metrics WHERE m1 >= 0.05 AND m2 >= 0.05 AND coalesce(m3, 1) >= 0.05)"""


_BY_AREA = _METRICS.replace("SELECT region, ref_area, round(avg", "SELECT region, ref_area, query_id % 3 AS area, round(avg")
_BY_PART = _BY_AREA.replace("query_id % 3 AS area", "query_id % 3 AS area, ref_gene % 2 AS ref_part").replace("{keys}", "region, ref_area, query_id % 3, ref_gene % 2")
_BY_AREA, _METRICS = _BY_AREA.replace("{keys}", "region, ref_area, query_id % 3"), _METRICS.replace("{keys}", "region, ref_area")


def _final(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    rows = _alignments(spark, folder).withColumn("area", F.col("query_id") % 3)
    metrics = rows.groupBy("region", "ref_area", *more).agg(F.round(F.avg("identity") / 100, 6).alias("m1"), F.round(F.max("coverage") / 100, 6).alias("m2"), F.when(F.col("ref_area") % 3 > 0, F.round(F.countDistinct("query_id") / F.count("*"), 6)).alias("m3"))
    return ops.final_score(metrics, ["m1", "m2", "m3"]).withColumn("final", F.round("final", 6))


@query("G12_final_score", with_tables(f", {_METRICS} SELECT region, ref_area, final FROM final", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _final(spark, folder).select("region", "ref_area", "final")


@query("G13_rank_region_region", with_tables(f", {_METRICS} SELECT region, ref_area, final, CAST(row_number() OVER (PARTITION BY region ORDER BY final DESC, ref_area) AS INT) AS rank FROM final QUALIFY rank <= 10", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.rank_region_region(_final(spark, folder), 10).select("region", "ref_area", "final", "rank")


_TOTAL = """n AS (SELECT region, count(DISTINCT area) AS k FROM {source} GROUP BY region), t AS (SELECT region, ref_area, sum(CASE WHEN k = 1 THEN final ELSE (exp(3 * final) - 1) / (exp(3.0) - 1) END) AS total FROM {source} JOIN n USING (region) GROUP BY ALL)
    SELECT region, ref_area, round(total, 6) AS total, CAST(row_number() OVER (PARTITION BY region ORDER BY round(total, 9) DESC, ref_area) AS INT) AS rank FROM t QUALIFY rank <= 10"""


@query("G14_rank_area_region", with_tables(f", {_BY_AREA}, {_TOTAL.format(source='final')}", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.rank_area_region(_final(spark, folder, "area"), 10).withColumn("total", F.round("total", 6))


@query("G15_rank_area_area", with_tables(f", {_BY_PART}, best AS (SELECT region, area, ref_area, max(final) AS final FROM final GROUP BY ALL), {_TOTAL.format(source='best')}", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder).withColumns({"area": F.col("query_id") % 3, "ref_part": F.col("ref_gene") % 2})
    metrics = rows.groupBy("region", "ref_area", "area", "ref_part").agg(F.round(F.avg("identity") / 100, 6).alias("m1"), F.round(F.max("coverage") / 100, 6).alias("m2"), F.when(F.col("ref_area") % 3 > 0, F.round(F.countDistinct("query_id") / F.count("*"), 6)).alias("m3"))
    scored = ops.final_score(metrics, ["m1", "m2", "m3"]).withColumn("final", F.round("final", 6))
    return ops.rank_area_area(scored, 10).withColumn("total", F.round("total", 6))


@query("G16_limit_details", with_tables(f", {_METRICS}, ranking AS (SELECT region, ref_area FROM final QUALIFY row_number() OVER (PARTITION BY region ORDER BY final DESC, ref_area) <= 5) SELECT region, ref_area, query_id, ref_gene, ord FROM alignments WHERE (region, ref_area) IN (SELECT (region, ref_area) FROM ranking)", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.limit_details(_alignments(spark, folder), ops.rank_region_region(_final(spark, folder), 5)).select("region", "ref_area", "query_id", "ref_gene", "ord")


@query("G17_core_similarity", with_tables("SELECT ord, CAST(identity AS BIGINT) / greatest(query_id % 900 + 1, ref_gene % 700 + 1) AS similarity FROM alignments WHERE CAST(identity AS BIGINT) / greatest(query_id % 900 + 1, ref_gene % 700 + 1) > 0.05", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder).select("ord", F.col("identity").cast("long").alias("n_identical"), (F.col("query_id") % 900 + 1).alias("query_length"), (F.col("ref_gene") % 700 + 1).alias("ref_length"))
    return ops.core_similarity(rows).select("ord", "similarity")


#: Pairs of residues that count as similar.
_ALIKE = "AS DN DE EQ ED EK FY FW HY HN IV IL IM KR KQ KE LM LI LV ML MI MV ND NH NS QE QR QK RK RQ SA SN ST TS VI VM VL WY WF YF YH YW"


@query("G18_consensus_string", with_tables(f""", s AS (SELECT record_id, string_split(upper(regexp_replace(seq, '[^a-zA-Z]', '', 'g')), '') AS t FROM sequences), p AS (SELECT record_id, t AS a, t[8:] AS b FROM s)
    SELECT record_id, coalesce(array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda k: CASE WHEN a[k] = b[k] THEN a[k] WHEN list_contains(string_split('{_ALIKE}', ' '), a[k] || b[k]) THEN '+' ELSE ' ' END), ''), '') AS consensus FROM p""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sequences").select("record_id", F.upper(F.regexp_replace("seq", "[^a-zA-Z]", "")).alias("t"))
    return rows.select("record_id", ops.consensus_string(F.col("t"), F.expr("substr(t, 8)")).alias("consensus"))


@query("G19_group_references", with_tables("SELECT query_id, ref_seq, ref_name, n_others FROM (SELECT query_id, ref_gene % 5 AS ref_seq, ord AS ref_name, score AS similarity, count(*) OVER (PARTITION BY query_id, ref_gene % 5) - 1 AS n_others FROM alignments) QUALIFY row_number() OVER (PARTITION BY query_id, ref_seq ORDER BY similarity DESC, ref_name) = 1", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _alignments(spark, folder).select("query_id", (F.col("ref_gene") % 5).alias("ref_seq"), F.col("ord").alias("ref_name"), F.col("score").alias("similarity"))
    return ops.group_references(rows).drop("similarity")



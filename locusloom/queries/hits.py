"""Queries on profile hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits as ops
from ..registry import query
from ..tables import table, with_tables

#: The order of the profile names that a hit table has, and groups of equivalents.
GROUPS = {"AF": 1, "AO": 1, "NF": 2, "NO": 2, "RF": 3}
_GROUPS_SQL = "(VALUES " + ", ".join(f"('{p}', {g})" for p, g in GROUPS.items()) + ") eq(profile, group_id)"
_ALL = 'record_id, gene_id, profile, "start", "end", score, evalue, ord'


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS.items()), "profile string, group_id int")


@query("B10_filter_by_cutoff", with_tables(f"SELECT {_ALL} FROM hits JOIN profiles USING (profile) WHERE score > cutoff", "hits", "profiles"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.filter_by_cutoff(table(spark, folder, "hits"), table(spark, folder, "profiles")).select("record_id", "gene_id", "profile", "start", "end", "score", "evalue", "ord")


@query("B11_filter_hits", with_tables(f"SELECT {_ALL} FROM hits WHERE score > 20000 AND evalue < 0.05", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.filter_hits(table(spark, folder, "hits"), 20000, 0.05)


@query("B12_refilter", with_tables(f"SELECT {_ALL} FROM hits WHERE score >= 30000 AND evalue <= 0.04", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.refilter(table(spark, folder, "hits"), (20000, 0.05), (30000, 0.04))


@query("B13_filter_area_hits", with_tables("""SELECT DISTINCT CAST(gene_id % 10 AS BIGINT) AS area_id, record_id, gene_id FROM hits
    WHERE (record_id, gene_id) IN (SELECT (record_id, gene_id) FROM hits WHERE score >= 60000 AND "end" - "start" >= 40)""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    members = hits.select((F.col("gene_id") % 10).alias("area_id"), "record_id", "gene_id").distinct()
    return ops.filter_area_hits(hits, members, 40, 60000)


@query("B14_filter_terminal", with_tables(f"""SELECT {_ALL} FROM hits JOIN (SELECT record_id, gene_id, max("end") + 20 AS len FROM hits GROUP BY ALL) USING (record_id, gene_id)
    WHERE profile NOT IN ('AF', 'NO') OR "start" < 50 OR len - "end" < 50""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    lengths = hits.groupBy("record_id", "gene_id").agg((F.max("end") + 20).alias("length"))
    return ops.filter_terminal(hits, lengths, ["AF", "NO"]).select("record_id", "gene_id", "profile", "start", "end", "score", "evalue", "ord")


@query("E1_first_per_pair", with_tables("""SELECT query_id, ref_gene, ord FROM alignments QUALIFY row_number() OVER (PARTITION BY query_id, ref_gene ORDER BY ord) = 1""", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.first_per_pair(table(spark, folder, "alignments")).select("query_id", "ref_gene", "ord")


@query("E2_best_per_profile", with_tables(f"SELECT {_ALL} FROM hits QUALIFY row_number() OVER (PARTITION BY record_id, gene_id, profile ORDER BY score DESC, ord) = 1", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.best_per_profile(table(spark, folder, "hits"))


@query("E3_resolve_equivalents", with_tables(f""", g AS (SELECT hits.*, group_id FROM hits JOIN {_GROUPS_SQL} USING (profile)),
    p AS (SELECT a.record_id AS r, a.gene_id AS gene, a.group_id AS k, a.ord AS a, b.ord AS b FROM g a JOIN g b ON a.record_id = b.record_id AND a.gene_id = b.gene_id AND a.group_id = b.group_id AND a.ord <> b.ord
          WHERE least(a."end", b."end") - greatest(a."start", b."start") > 20),
    reach AS (SELECT r, gene, k, a, b FROM p UNION SELECT x.r, x.gene, x.k, x.a, p.b FROM reach x JOIN p ON p.r = x.r AND p.gene = x.gene AND p.k = x.k AND p.a = x.b),
    c AS (SELECT g.*, least(ord, (SELECT min(b) FROM reach WHERE r = record_id AND k = group_id AND a = ord)) AS comp FROM g),
    best AS (SELECT record_id, ord FROM c QUALIFY row_number() OVER (PARTITION BY record_id, gene_id, group_id, comp ORDER BY score DESC, profile, ord) = 1)
    SELECT {_ALL} FROM hits WHERE profile NOT IN (SELECT profile FROM g) OR (record_id, ord) IN (SELECT (record_id, ord) FROM best)""", "hits", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.resolve_equivalents(table(spark, folder, "hits"), _groups(spark))


def folded(name: str, source: str, order: str, first: str, then: str, keys: str = "record_id, gene_id") -> str:
    """CTEs that fold each key's rows in order, one recursion step per row; ``name`` has the keys and one struct ``k`` per kept row.

    ``first`` is the list after the first row ``x``; ``then`` the list after row ``x``, from ``w.kept``.
    """
    names = [k.strip() for k in keys.split(",")]
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
    {name}_walk AS (SELECT {keys}, 1 AS step, {first} AS kept FROM {name}_ranked x WHERE rn = 1
        UNION ALL SELECT {", ".join(f"w.{k}" for k in names)}, w.step + 1, {then} FROM {name}_walk w JOIN {name}_ranked x ON {" AND ".join(f"w.{k} = x.{k}" for k in names)} AND x.rn = w.step + 1),
    {name} AS (SELECT {keys}, unnest(kept) AS k FROM (SELECT * FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY step DESC) = 1))"""


_SIZED = "(SELECT h.*, length, cutoff FROM {} h JOIN profiles USING (profile))"
_HIT = """{'profile': x.profile, 's': x."start", 'e': x."end", 'score': x.score, 'evalue': x.evalue, 'ord': x.ord, 'len': x.length}"""
_OUT = 'record_id, gene_id, k.profile AS profile, k.s AS "start", k.e AS "end", k.score AS score, k.evalue AS evalue, k.ord AS ord'
_MERGED = """{'profile': w.kept[-1].profile, 's': w.kept[-1].s, 'e': greatest(w.kept[-1].e, x."end"), 'score': greatest(w.kept[-1].score, x.score), 'evalue': least(w.kept[-1].evalue, x.evalue), 'ord': w.kept[-1].ord, 'len': x.length}"""

_GREEDY = folded("g", _SIZED.format("hits"), 'cutoff / score, 1 / ("end" - "start"), "start", profile, ord', f"[{_HIT}]",
    f"""CASE WHEN len(list_filter(w.kept, lambda k: x."start" <= k.e - 10 AND x."end" >= k.s + 10)) > 0 THEN w.kept ELSE list_append(w.kept, {_HIT}) END""")
_FRAGMENTS = folded("f", _SIZED.format("hits"), '"start", "end", ord', f"[{_HIT}]", f"""CASE WHEN x."end" - w.kept[-1].s < 1.5 * x.length THEN [{_MERGED}] ELSE [{_HIT}] END""", "record_id, gene_id, profile")
_NEIGHBOURS = """CASE WHEN w.kept[-1].profile = x.profile AND x."end" - w.kept[-1].s < 1.5 * x.length THEN list_append(w.kept[:-2], {merged}) ELSE list_append(w.kept, {hit}) END""".replace("{merged}", _MERGED).replace("{hit}", _HIT)
_REPLACED = f"""CASE WHEN x."start" < w.kept[-1].e - 0.2 * greatest(x.length, w.kept[-1].len) THEN CASE WHEN x.score > w.kept[-1].score THEN list_append(w.kept[:-2], {_HIT}) ELSE w.kept END ELSE list_append(w.kept, {_HIT}) END"""


@query("E4_greedy_non_overlapping", with_tables(f", {_GREEDY} SELECT {_OUT} FROM g", "hits", "profiles", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.greedy_non_overlapping(table(spark, folder, "hits"), table(spark, folder, "profiles"))


@query("E5_merge_fragments", with_tables(f", {_FRAGMENTS} SELECT {_OUT} FROM f", "hits", "profiles", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.merge_fragments(table(spark, folder, "hits"), table(spark, folder, "profiles"))


@query("E6_merge_neighbours", with_tables(", " + folded("n", _SIZED.format("hits"), '"start", "end", ord', f"[{_HIT}]", _NEIGHBOURS) + f" SELECT {_OUT} FROM n", "hits", "profiles", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.merge_neighbours(table(spark, folder, "hits"), table(spark, folder, "profiles"))


@query("E7_replace_overlaps", with_tables(", " + folded("r", _SIZED.format("hits"), '"start", "end", ord', f"[{_HIT}]", _REPLACED) + f" SELECT {_OUT} FROM r", "hits", "profiles", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.replace_overlaps(table(spark, folder, "hits"), table(spark, folder, "profiles"))


_INCOMPLETE = f"""sized AS (SELECT *, CAST("end" - "start" AS DOUBLE) / (length * 1.0) AS share, "end" - "start" > 0.5 * length AS whole FROM {{source}}),
    tiers AS (SELECT *, bool_or(whole) OVER g AS any_whole, max(share) OVER g AS longest, row_number() OVER (PARTITION BY record_id, gene_id ORDER BY share DESC, "start", ord) AS n FROM sized WINDOW g AS (PARTITION BY record_id, gene_id))
    SELECT {_ALL} FROM tiers WHERE CASE WHEN any_whole THEN whole WHEN longest > 1.0 / 3 THEN n = 1 ELSE false END"""


@query("E8_drop_incomplete", with_tables(", " + _INCOMPLETE.format(source="(SELECT hits.*, length * 3 AS length FROM hits JOIN profiles USING (profile))"), "hits", "profiles"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.drop_incomplete(table(spark, folder, "hits"), table(spark, folder, "profiles").withColumn("length", F.col("length") * 3))


@query("E9_refine_hits", with_tables(f""", {_FRAGMENTS}, fragments AS (SELECT {_OUT} FROM f),
    {folded("r", _SIZED.format("fragments"), '"start", "end", ord', f"[{_HIT}]", _REPLACED)}, replaced AS (SELECT {_OUT} FROM r),
    {_INCOMPLETE.format(source=_SIZED.format("replaced"))}""", "hits", "profiles", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.refine_hits(table(spark, folder, "hits"), table(spark, folder, "profiles"))


@query("E10_overlap_groups", with_tables(f""", r AS (SELECT *, max("end") OVER (PARTITION BY record_id, gene_id ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)
    SELECT {_ALL}, CAST(sum(CASE WHEN reach IS NULL OR "start" >= reach - 20 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, gene_id ORDER BY "start", "end", ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS overlap_group FROM r""", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.overlap_groups(table(spark, folder, "hits"))


@query("E11_best_per_gene", with_tables(f"SELECT {_ALL} FROM hits QUALIFY row_number() OVER (PARTITION BY record_id, gene_id ORDER BY score DESC, ord) = 1", "hits"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.best_per_gene(table(spark, folder, "hits"))


_PAIR = "{'q': x.query_id, 'r': x.ref_gene, 'identity': x.identity, 'ord': x.ord}"


@query("E12_one_to_one", with_tables(", " + folded("p", "alignments", "identity DESC, ref_gene DESC, ord", f"[{_PAIR}]",
    f"CASE WHEN len(list_filter(w.kept, lambda k: k.q = x.query_id OR k.r = x.ref_gene)) > 0 THEN w.kept ELSE list_append(w.kept, {_PAIR}) END", "region, ref_area")
    + " SELECT region, ref_area, k.q AS query_id, k.r AS ref_gene, k.identity AS identity, k.ord AS ord FROM p", "alignments", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.one_to_one(table(spark, folder, "alignments"))


@query("E13_dedup_sequences", with_tables("SELECT record_id, min(record_id) OVER (PARTITION BY seq) AS kept_id FROM sequences", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_sequences(table(spark, folder, "sequences"))


_AREAS = """areas AS (SELECT record_id, island * 7 + ascii(profile) AS area_id, min("start") - (min("start") % 3) * 400 AS "start", max("end") + 300 AS "end", substr(profile, 1, 1) AS label FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, profile ORDER BY "start", "end", gene_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max("end") OVER (PARTITION BY record_id, profile ORDER BY "start", "end", gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes)) GROUP BY record_id, profile, island)"""


@query("E14_drop_overlapping_genes", with_tables(", ".join(["", *[f"""l{k} AS (SELECT record_id, gene_id, "start", "end" FROM (SELECT *, lag("end") OVER (PARTITION BY record_id ORDER BY "start", "end", gene_id) AS last FROM {'genes' if k == 0 else f'l{k - 1}'}) WHERE last IS NULL OR "start" >= last)""" for k in range(8)]]) + ' SELECT record_id, gene_id, "start", "end" FROM l7', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.drop_overlapping_genes(table(spark, folder, "genes").select("record_id", "gene_id", "start", "end"))


@query("E15_drop_contained", with_tables(f""", {_AREAS} SELECT * FROM areas a WHERE NOT EXISTS (SELECT 1 FROM areas o WHERE o.record_id = a.record_id AND o.label = a.label AND o."start" <= a."start" AND a."end" <= o."end"
    AND (o."end" - o."start" > a."end" - a."start" OR (o."end" - o."start" = a."end" - a."start" AND o.area_id < a.area_id)))""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.intervals import islands

    groups = islands(table(spark, folder, "genes"), ["record_id", "profile"], gap=1000, order=["gene_id"])
    areas = groups.groupBy("record_id", "profile", "island").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    areas = areas.select("record_id", ((F.col("island") + 1) * 7 + F.ascii("profile")).alias("area_id"), (F.col("low") - (F.col("low") % 3) * 400).alias("start"), (F.col("high") + 300).alias("end"), F.substring("profile", 1, 1).alias("label"))
    return ops.drop_contained(areas)


@query("E16_best_strand", with_tables("""SELECT record_id, "start", strand, score FROM (SELECT record_id, gene_id % 97 AS "start", strand, score FROM genes) QUALIFY row_number() OVER (PARTITION BY record_id, "start" ORDER BY score DESC, strand) = 1""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "genes").select("record_id", (F.col("gene_id") % 97).alias("start"), "strand", "score")
    return ops.best_strand(points)

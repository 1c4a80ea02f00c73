"""Queries on modules of assembly-line genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as ops
from ..operators import compare as compare_ops
from ..plans.checkpoints import cut
from ..registry import query
from ..tables import table, with_tables

_in = lambda *names: "(" + ", ".join(f"'{n}'" for name in names for n in ops.DOMAIN_CLASSES[name]) + ")"


def _walk(name: str, source: str) -> str:
    """SQL that walks over sequences of domains (``id, i, profile, subtype``): ``name`` has the state after each domain; m is its module."""
    fits = f"""CASE WHEN d.profile IN {_in("C", "KS")} OR d.profile = 'SAT' THEN false WHEN w.gr > 0 OR d.profile IN {_in("!")} THEN true WHEN w.en <> '' THEN false
        WHEN d.profile IN {_in("A", "AT")} OR d.profile = 'CAL_domain' THEN w.ld = '' AND NOT w.md AND NOT w.cp AND NOT (w.st IN {_in("KS", "AT")} AND d.profile IN {_in("A")}) AND NOT (w.st IN {_in("C", "A")} AND d.profile IN {_in("AT")})
        WHEN d.profile IN {_in("+")} THEN NOT w.cp OR (d.profile = 'PKS_KR' AND w.pk AND w.st <> '' AND w.ld = '' AND (w.st = 'PKS_KS:Trans-AT-KS' OR w.dk))
        WHEN d.profile IN {_in("CP")} THEN NOT w.cp OR d.double ELSE true END"""
    fits = fits.replace(f"w.st IN {_in('KS', 'AT')}", f"split_part(w.st, ':', 1) IN {_in('KS', 'AT')}")
    return f"""{name}_d AS (SELECT *, coalesce(lead(profile) OVER o = 'LPG_synthase_C' AND lead(profile, 2) OVER o = 'Beta_elim_lyase', false) AS double, profile IN {_in("ignore")} AS skip FROM {source} WINDOW o AS (PARTITION BY id ORDER BY i)),
    {name} AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, 0 AS m, false AS b, '' AS st, '' AS ld, false AS pk, false AS md, false AS cp, '' AS en, false AS dk, 0 AS gr, true AS skip FROM {source}
    UNION ALL SELECT id, i, CASE WHEN nw THEN m + 1 ELSE m END, b OR NOT skip,
        CASE WHEN skip THEN st WHEN opener AND (nw OR st = '') THEN CASE WHEN profile = 'PKS_KS' THEN 'PKS_KS:' || coalesce(subtype, '') ELSE profile END WHEN nw THEN '' ELSE st END,
        CASE WHEN skip THEN ld WHEN loader THEN profile WHEN nw THEN '' ELSE ld END, CASE WHEN skip THEN pk ELSE (pk AND NOT nw) OR profile LIKE 'PKS%' END,
        CASE WHEN skip THEN md ELSE (md AND NOT nw) OR profile IN {_in("+")} END, CASE WHEN skip THEN cp ELSE (cp AND NOT nw) OR profile IN {_in("CP")} END,
        CASE WHEN skip THEN en WHEN profile IN {_in("E")} THEN profile WHEN nw THEN '' ELSE en END, CASE WHEN skip THEN dk ELSE (dk AND NOT nw) OR profile = 'Trans-AT_docking' END,
        CASE WHEN skip THEN gr WHEN NOT nw AND cp AND double AND profile IN {_in("CP")} THEN 2 WHEN nw THEN 0 ELSE greatest(0, gr - 1) END, skip
    FROM (SELECT w.id, d.i, w.m, w.b, w.st, w.ld, w.pk, w.md, w.cp, w.en, w.dk, w.gr, d.profile, d.subtype, d.double, d.skip, d.profile IN {_in("A", "AT", "C", "S", "KS")} AS opener, d.profile IN {_in("A", "AT")} OR d.profile = 'CAL_domain' AS loader,
        NOT d.skip AND w.b AND NOT ({fits}) AS nw FROM {name} w JOIN {name}_d d ON d.id = w.id AND d.i = w.i + 1))"""


_SEQ = """s AS (SELECT gene_id AS id, record_id, gene_id, "start", "end", ord, profile, subtype, row_number() OVER (PARTITION BY gene_id ORDER BY "start", "end", ord) AS i FROM domains)"""
_LAST = """z AS (SELECT w.*, s.record_id, s.gene_id FROM walk w JOIN s USING (id, i) WHERE NOT skip QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY i DESC) = 1),
    heads AS (SELECT w.id, w.m, s.profile, count(*) OVER (PARTITION BY w.id, w.m) AS n FROM walk w JOIN s USING (id, i) WHERE NOT skip QUALIFY row_number() OVER (PARTITION BY w.id, w.m ORDER BY i) = 1),
    f AS (SELECT z.*, heads.profile AS head, n, pk AND st <> '' AND ld = '' AND (st = 'PKS_KS:Trans-AT-KS' OR dk) AS trans, {peptide} AS peptide, ld <> '' AND st = ld AS alone FROM z JOIN heads USING (id, m)),
    props AS (SELECT *, cp AND (trans OR (ld <> '' AND (NOT alone OR m = 0))) AS complete, CASE WHEN peptide THEN 'nrps' WHEN pk THEN 'pks' ELSE 'unknown' END AS kind FROM f)""".replace("{peptide}", f"st IN {_in('C', 'A')} OR ld IN {_in('A')}")


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    return ops.segment_modules(table(spark, folder, "domains"))


@query("I2_segment_modules", with_tables(f", {_SEQ}, {_walk('walk', 's')} SELECT record_id, gene_id, ord, m AS module FROM walk JOIN s USING (id, i) WHERE NOT skip", "domains", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _segmented(spark, folder).select("record_id", "gene_id", "ord", "module")


@query("I3_module_properties", with_tables(f""", {_SEQ}, {_walk("walk", "s")}, {_LAST}
    SELECT record_id, gene_id, m AS module, CAST(n AS INT) AS n_domains, complete, st IN ('Condensation_Starter', 'SAT', 'CAL_domain') OR (alone AND m = 0) AS starter, en IN ('Thioesterase', 'TD') AS terminating, trans AS trans_at, st = 'PKS_KS:Iterative-KS' AS iterative, kind FROM props""", "domains", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.module_properties(_segmented(spark, folder)).drop("fused", "peptide", "polyketide")


_JOINED = f"""{_SEQ}, {_walk("walk", "s")}, {_LAST}, span AS (SELECT gene_id, min(m) AS low, max(m) AS high FROM props GROUP BY ALL),
    g AS (SELECT l.*, low, high, row_number() OVER o AS place, lead(l.gene_id) OVER o AS g2, lead(strand) OVER o AS s2, lead(low) OVER o AS l2, lead(high) OVER o AS h2 FROM lines l LEFT JOIN span USING (gene_id) WINDOW o AS (PARTITION BY l.record_id, region ORDER BY l."start", l.gene_id)),
    p AS (SELECT record_id, region, place, gene_id AS pair, low = high AS single, CASE WHEN strand = 1 THEN gene_id ELSE g2 END AS hg, CASE WHEN strand = 1 THEN high ELSE h2 END AS hm, CASE WHEN strand = 1 THEN g2 ELSE gene_id END AS tg, CASE WHEN strand = 1 THEN l2 ELSE low END AS tm FROM g WHERE strand = s2 AND low IS NOT NULL AND l2 IS NOT NULL),
    q AS (SELECT p.* FROM p JOIN props h ON h.gene_id = hg AND h.m = hm JOIN props t ON t.gene_id = tg AND t.m = tm WHERE NOT h.complete AND (NOT t.complete OR t.head IN ('AMP-binding', 'A-OX', 'PKS_AT', 'Interface')) AND NOT (h.pk AND t.peptide) AND NOT (h.peptide AND t.pk)),
    member AS (SELECT s.*, m FROM walk JOIN s USING (id, i) WHERE NOT skip),
    both_parts AS (SELECT pair AS id, row_number() OVER (PARTITION BY pair ORDER BY part, i) AS i, profile, subtype FROM (SELECT pair, 0 AS part, i, profile, subtype FROM q JOIN member ON gene_id = hg AND m = hm UNION ALL SELECT pair, 1, i, profile, subtype FROM q JOIN member ON gene_id = tg AND m = tm)),
    {_walk("second", "both_parts")},
    ended AS (SELECT *, pk AND st <> '' AND ld = '' AND (st = 'PKS_KS:Trans-AT-KS' OR dk) AS trans FROM second WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
    able AS (SELECT q.*, trans, coalesce(single AND lag(place) OVER (PARTITION BY record_id, region ORDER BY place) = place - 1, false) AS follows FROM q JOIN ended ON ended.id = pair WHERE ended.m = 0 AND cp AND (trans OR (ld <> '' AND ld <> st))),
    runs AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY record_id, region ORDER BY place) AS run FROM able),
    taken AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY record_id, region, run ORDER BY place) % 2 = 1),
    ends AS (SELECT hg AS gene_id, hm AS m, hg AS owner, hm AS into_, 0 AS part FROM taken UNION ALL SELECT tg, tm, hg, hm, 1 FROM taken),
    kr AS (SELECT tg AS gene_id, tm + 1 AS m, hg AS owner, hm AS into_, 2 AS part FROM taken JOIN props ON gene_id = tg AND m = tm + 1 WHERE taken.trans AND n = 1 AND head = 'PKS_KR' AND (tg, tm + 1) NOT IN (SELECT (gene_id, m) FROM ends)),
    every AS (SELECT * FROM ends UNION ALL SELECT * FROM kr),
    joined AS (SELECT a.*, coalesce(owner, a.gene_id) AS owner, coalesce(into_, a.m) AS module, owner IS NOT NULL AS later, coalesce(part, 0) AS part FROM member a LEFT JOIN every e ON e.gene_id = a.gene_id AND e.m = a.m)"""


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    return ops.join_modules(_segmented(spark, folder), table(spark, folder, "lines"))


@query("I4_join_modules", with_tables(f", {_JOINED} SELECT record_id, gene_id, ord, owner, module, later, part FROM joined", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(spark, folder).select("record_id", "gene_id", "ord", "owner", "module", "later", "part")


_AMINO = "ala,gly,ser,thr,val,leu,ile,phe"
_MATCHED = f"""preds AS (SELECT ord, l % 9 = 0 AS uncertain, split_part('{_AMINO}', ',', l % 8 + 1) AS a1, split_part('{_AMINO}', ',', o % 8 + 1) AS a2, 0.7 + (l % 4) / 10.0 AS c1, 0.7 + (o % 4) / 10.0 AS c2, 0.5 + (l % 3) / 10.0 AS h1, 0.5 + (o % 3) / 10.0 AS h2, n % 3 AS k,
    CASE WHEN l % 3 = 0 THEN split_part('{_AMINO}', ',', (l + o) % 8 + 1) END AS single, CASE WHEN o % 2 = 0 THEN split_part('{_AMINO}', ',', l % 8 + 1) || ',' || split_part('{_AMINO}', ',', n % 8 + 1) END AS small, CASE WHEN l % 2 = 0 THEN '{_AMINO}' END AS large
    FROM (SELECT ord, CAST(ref_gene AS INT) AS l, CAST(query_id AS INT) AS o, CAST(ref_idx AS INT) AS n FROM alignments))"""


@query("I8_combine_predictions", with_tables(f""", {_MATCHED}, t AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN round(c1, 1) ELSE greatest(round(c1, 1), round(c2, 1)) END AS quality, k = 2 AND (round(c2, 1) > round(c1, 1) OR (round(c2, 1) = round(c1, 1) AND round(h2, 1) > round(h1, 1))) AS turned FROM preds),
    u AS (SELECT *, CASE WHEN k = 0 THEN [] WHEN k = 1 THEN [a1] WHEN turned THEN [a2, a1] ELSE [a1, a2] END AS every, CASE WHEN k = 0 THEN [] WHEN k = 1 OR round(h1, 1) <> round(h2, 1) THEN CASE WHEN turned THEN [a2] ELSE [a1] END WHEN turned THEN [a2, a1] ELSE [a1, a2] END AS best, string_split(coalesce(small, large), ',') AS tight FROM t),
    v AS (SELECT ord, CASE WHEN uncertain THEN CASE WHEN quality >= 0.8 THEN best ELSE [] END WHEN quality = 1 THEN best WHEN single IS NOT NULL AND quality = 0.9 THEN CASE WHEN list_contains(every, single) THEN [single] ELSE [] END WHEN single IS NOT NULL THEN [single]
        WHEN quality >= 0.8 THEN CASE WHEN tight IS NULL THEN every ELSE list_filter(every, lambda x: list_contains(tight, x)) END ELSE coalesce(tight, []) END AS c FROM u)
    SELECT ord, coalesce(array_to_string(list_sort(list_distinct(c)), ','), '') AS substrates FROM v""", "alignments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    l, o, n = F.col("ref_gene").cast("int"), F.col("query_id").cast("int"), F.col("ref_idx").cast("int")
    name = lambda x: F.split_part(F.lit(_AMINO), F.lit(","), x % 8 + 1)
    match = lambda x: F.struct(F.array(name(x)).alias("substrates"), F.round(0.7 + (x % 4) / 10, 1).alias("code"), F.round(0.5 + (x % 3) / 10, 1).alias("long_code"))
    matches = F.slice(F.array(match(l), match(o)), F.lit(1), n % 3)
    small, large = F.when(o % 2 == 0, F.array(name(l), name(n))), F.when(l % 2 == 0, F.split(F.lit(_AMINO), ","))
    found = ops.combine_predictions(matches, F.when(l % 3 == 0, F.array(name(l + o))), [small, large], l % 9 == 0)
    return table(spark, folder, "alignments").select("ord", F.array_join(F.sort_array(found), ",").alias("substrates"))


_BASES = "mal,mmal,mxmal,emal,ala,pk,"
_MONOMER = f"""built AS (SELECT record_id, owner, module, list(profile ORDER BY part, i) AS ps, bool_or(later) AS later, split_part('{_BASES}', ',', CAST(owner % 7 + 1 AS INT)) AS base0 FROM joined GROUP BY ALL),
    b1 AS (SELECT *, list_contains(ps, 'PKS_KS') AS pks, CASE WHEN list_contains(ps, 'PKS_KS') AND NOT list_contains(ps, 'PKS_AT') THEN 'mal' ELSE base0 END AS b FROM built),
    b2 AS (SELECT *, CASE WHEN pks AND list_contains(ps, 'PKS_KR') AND b IN ('mal', 'mmal', 'mxmal', 'emal') THEN 'oh' || b ELSE b END AS c FROM b1),
    b3 AS (SELECT *, CASE WHEN pks AND list_has_any(ps, ['PKS_DH', 'PKS_DH2', 'PKS_DHt']) AND c IN ('ohmal', 'ohmmal', 'ohmxmal', 'ohemal') THEN 'cc' || c[3:] ELSE c END AS d FROM b2),
    b4 AS (SELECT *, CASE WHEN pks AND list_contains(ps, 'PKS_ER') AND d IN ('ccmal', 'ccmmal', 'ccmxmal', 'ccemal') THEN 'red' || d[3:] ELSE d END AS e FROM b3),
    monomers AS (SELECT record_id, owner, module, base0 AS substrate, CASE WHEN e = '' THEN '' ELSE CASE WHEN list_contains(ps, 'Epimerization') THEN 'D-' ELSE '' END || coalesce(array_to_string(list_transform(list_filter(ps, lambda p: p IN ('nMT', 'cMT', 'oMT')), lambda p: CASE p WHEN 'nMT' THEN 'NMe-' WHEN 'cMT' THEN 'Me-' ELSE 'OMe-' END), ''), '')
        || CASE WHEN ends_with(e, 'mmal') THEN 'Me-' || e[:-5] || 'mal' ELSE e END END AS monomer FROM b4)"""


def _dealt(spark: SparkSession, folder: str) -> DataFrame | None:
    """Genes with their modules, dealt by record once; none where the records do not allow it."""
    domains, lines = table(spark, folder, "domains"), table(spark, folder, "lines")
    return ops.record_genes(domains, lines) if ops.plain_lines(domains, lines) else None


def _monomers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _joined(spark, folder)
    modules = rows.groupBy("record_id", "owner", "module").agg(F.sort_array(F.collect_list(F.struct("part", "start", "end", "ord", "profile"))).alias("d"))
    return _monomers_of(modules.select("record_id", "owner", "module", F.transform("d", lambda d: d["profile"]).alias("profiles")))


def _monomers_of(modules: DataFrame) -> DataFrame:
    modules = modules.withColumn("substrate", F.split_part(F.lit(_BASES), F.lit(","), (F.col("owner") % 7 + 1).cast("int")))
    pks = F.array_contains("profiles", "PKS_KS")
    return modules.withColumn("monomer", ops.monomer(F.col("substrate"), F.col("profiles"), pks, pks & ~F.array_contains("profiles", "PKS_AT")))


@query("I10_monomers", with_tables(f", {_JOINED}, {_MONOMER} SELECT record_id, owner, module, monomer FROM monomers", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _monomers(spark, folder).select("record_id", "owner", "module", "monomer")


CODES = [("mal", "CC(=O)O"), ("ohmal", "C(O)CC(=O)O"), ("ccmal", "C=CC(=O)O"), ("redmal", "CCC(=O)O"), ("me-mal", "C(C)C(=O)O"), ("me-ohmal", "C(O)C(C)C(=O)O"), ("ala", "NC(C)C(=O)O"), ("d-ala", "N[C@H](C)C(=O)O"), ("pk", "C([*])C(-O)")]


@query("I16_structures", with_tables(f""", {_JOINED}, {_MONOMER}, codes(name, code) AS (VALUES {", ".join(map(str, CODES))}),
    c AS (SELECT record_id, owner, module, monomer, coalesce(a.code, b.code, '') AS code, row_number() OVER (PARTITION BY record_id ORDER BY owner DESC, module DESC) AS back FROM monomers LEFT JOIN codes a ON a.name = lower(monomer) LEFT JOIN codes b ON b.name = lower(substrate))
    SELECT record_id, string_agg(CASE WHEN back > 1 AND ends_with(code, 'C(=O)O') THEN code[:-2] ELSE code END, '' ORDER BY owner, module) || CASE WHEN ends_with(any_value(monomer) FILTER (back = 1), 'mal') THEN 'C(=O)O' ELSE '' END AS structure FROM c GROUP BY record_id""", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    modules = _monomers(spark, folder) if (genes := _dealt(spark, folder)) is None else _monomers_of(ops.owned_modules(genes))
    codes = F.broadcast(spark.createDataFrame(CODES, "name string, code string"))  # as many as are written in code
    return ops.structure_string(modules.withColumn("place", F.struct("owner", "module")), codes, ["record_id"])


# Gene order: what a gene's first and last modules are, over the regions of joined modules.
_GENES_SQL = f"""names AS (SELECT gene_id, list(profile ORDER BY i) AS ps FROM s GROUP BY ALL), member_of AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY m1) AS k, row_number() OVER (PARTITION BY gene_id ORDER BY m1 DESC) AS back FROM (SELECT gene_id, owner, module, min(part) AS part, min(m) AS m1 FROM joined GROUP BY gene_id, owner, module)),
    split AS (SELECT owner, module, count(DISTINCT gene_id) AS genes FROM joined GROUP BY ALL),
    shape AS (SELECT owner, module, list(profile ORDER BY part, i) AS ps, bool_or(later) AS later, (list(profile ORDER BY part, i) FILTER (profile IN {_in("A", "AT", "C", "S", "KS")}))[1] AS st FROM joined GROUP BY ALL),
    facts AS (SELECT gene_id, bool_or(k = 1 AND (st IN ('Condensation_Starter', 'SAT', 'CAL_domain') OR (NOT later AND x.module = 0 AND (st IN {_in("A", "AT")})))) AS opens, bool_or(back = 1 AND list_has_any(ps, ['Thioesterase', 'TD']) AND NOT (genes > 1 AND part = 0)) AS closes FROM member_of x JOIN split p ON p.owner = x.owner AND p.module = x.module JOIN shape h ON h.owner = x.owner AND h.module = x.module GROUP BY gene_id),
    line_genes AS (SELECT l.record_id, region, l.gene_id, l."start", strand, coalesce(opens, false) AS opens, coalesce(closes, false) AS closes, coalesce(ps[1:3] IN (['PKS_KS', 'PKS_AT', 'ACP'], ['PKS_KS', 'PKS_AT', 'PKS_PP']), false) AS classic, coalesce(list_has_any(ps, ['Thioesterase', 'TD']) AND len(ps) > 1, false) AS ends FROM lines l LEFT JOIN facts USING (gene_id) LEFT JOIN names USING (gene_id))"""
_ENDS_SQL = """e AS (SELECT record_id, region, CASE WHEN count(*) FILTER (closes) = 1 THEN max(gene_id) FILTER (closes) END AS end_gene FROM line_genes GROUP BY ALL),
    o AS (SELECT g.record_id, g.region, end_gene, count(*) FILTER (opens AND gene_id IS DISTINCT FROM end_gene) AS n, max(gene_id) FILTER (opens AND gene_id IS DISTINCT FROM end_gene) AS a, count(*) FILTER (classic AND gene_id IS DISTINCT FROM end_gene) AS m, max(gene_id) FILTER (classic AND gene_id IS DISTINCT FROM end_gene) AS c FROM line_genes g JOIN e ON e.record_id = g.record_id AND e.region = g.region GROUP BY ALL),
    ends_of AS (SELECT record_id, region, CASE WHEN n = 1 THEN a WHEN n = 0 AND m = 1 THEN c END AS start_gene, end_gene FROM o)"""


def line_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Genes of the regions with what their modules say about an end, and whether they share a module with the gene before them."""
    rows = cut(_joined(spark, folder))
    modules = rows.groupBy("gene_id", "owner", "module").agg(F.min("part").alias("part"), F.min("kind").alias("_"), F.min(F.struct("start", "end", "ord")).alias("first")).drop("_")
    shape = ops.module_properties(rows, ["record_id", "owner", "module"]).select("owner", "module", "starter", "terminating")
    split = rows.groupBy("owner", "module").agg(F.countDistinct("gene_id").alias("genes"))
    known = modules.join(shape, ["owner", "module"]).join(split, ["owner", "module"])
    ends = known.groupBy("gene_id").agg(F.min_by("starter", "first").alias("opens"), F.max_by(F.col("terminating") & ~((F.col("genes") > 1) & (F.col("part") == 0)), "first").alias("closes"))
    pairs = known.where("genes > 1").groupBy("owner", "module").agg(F.min("gene_id").alias("low"), F.max("gene_id").alias("gene_id")).select("gene_id").distinct().withColumn("chained", F.lit(True))
    names = table(spark, folder, "domains").groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "ord", "profile"))).alias("d")).select("gene_id", F.transform("d", lambda d: d["profile"]).alias("ps"))
    return _flagged(table(spark, folder, "lines").join(ends, "gene_id", "left").join(pairs, "gene_id", "left").join(names, "gene_id", "left"))


def _flagged(joined: DataFrame) -> DataFrame:
    classic = F.array_join(F.slice("ps", 1, 3), " ").isin("PKS_KS PKS_AT ACP", "PKS_KS PKS_AT PKS_PP")
    last = F.arrays_overlap("ps", F.array(*[F.lit(t) for t in ops.TERMINATORS])) & (F.size("ps") > 1)
    flags = {"opens": F.col("opens"), "closes": F.col("closes"), "classic": classic, "chained": F.col("chained"), "ends": last}
    return joined.select("record_id", "region", "gene_id", "start", "strand", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


@query("I12_find_ends", with_tables(f", {_JOINED}, {_GENES_SQL}, {_ENDS_SQL} SELECT record_id, region, start_gene, end_gene FROM ends_of", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.find_ends(line_genes(spark, folder), ["record_id", "region"])


@query("I11_colinear_groups", with_tables(f""", {_JOINED}, {_GENES_SQL}, two AS (SELECT greatest(hg, tg) AS gene_id FROM taken UNION SELECT greatest(hg, tg) FROM taken),
    c AS (SELECT g.*, two.gene_id IS NOT NULL AS chained FROM line_genes g LEFT JOIN two USING (gene_id)),
    h AS (SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY record_id, region ORDER BY "start", gene_id) AS chain, sum(strand) OVER (PARTITION BY record_id, region) AS d, strand * "start" AS inside FROM c),
    t AS (SELECT *, CASE WHEN d < 0 THEN -chain ELSE chain END AS turned FROM h), x AS (SELECT *, first_value(ends) OVER (PARTITION BY record_id, region ORDER BY turned, inside, gene_id) AS flip FROM t)
    SELECT record_id, region, gene_id, CAST(row_number() OVER (PARTITION BY record_id, region ORDER BY CASE WHEN flip THEN -turned ELSE turned END, inside, gene_id) AS INT) AS place FROM x""", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["record_id", "region"]
    if (genes := _dealt(spark, folder)) is not None:
        return ops.colinear_places(_flagged(ops.ends_of(genes)), keys).select(*keys, "gene_id", "place")
    return ops.colinear_groups(line_genes(spark, folder), keys).select(*keys, "gene_id", "place")


_LETTERS = "AKDGHE"
_UNITS = f"""units AS (SELECT CAST(floor(o_orderkey / 5) AS BIGINT) AS area_id, CAST(o_orderkey AS BIGINT) AS unit, CAST(o_orderkey * 1000 AS BIGINT) AS "start", CASE WHEN o_orderkey % 11 = 0 THEN 'start' WHEN o_orderkey % 13 = 0 THEN 'end' END AS role,
    CASE WHEN o_custkey % 5 > 0 THEN substr('{_LETTERS}', CAST(o_custkey % 6 + 1 AS INT), 1) || substr('{_LETTERS}', CAST(o_custkey % 4 + 2 AS INT), 1) END AS tail, CASE WHEN o_custkey % 7 > 0 THEN substr('{_LETTERS}', CAST(o_custkey % 5 + 1 AS INT), 1) || substr('{_LETTERS}', CAST(o_custkey % 3 + 1 AS INT), 1) END AS head FROM orders)"""
_PULL = "CASE WHEN {a} IN ('A') AND {b} IN ('A') THEN 1 WHEN ({a} IN ('K', 'H') AND {b} IN ('D', 'E')) OR ({a} IN ('D', 'E') AND {b} IN ('K', 'H')) THEN 1 WHEN ({a} IN ('K', 'H') AND {b} IN ('K', 'H')) OR ({a} IN ('D', 'E') AND {b} IN ('D', 'E')) THEN -1 ELSE 0 END"


@query("I13_best_order", f"""WITH RECURSIVE {_UNITS}, n AS (SELECT area_id, count(*) FILTER (role IS NULL) AS n, max(unit) FILTER (role = 'start') AS s, max(unit) FILTER (role = 'end') AS e FROM units GROUP BY ALL),
    free AS (SELECT area_id, unit FROM units WHERE role IS NULL), paths AS (SELECT area_id, CAST([] AS BIGINT[]) AS path FROM n UNION ALL SELECT p.area_id, list_append(path, unit) FROM paths p JOIN free f ON f.area_id = p.area_id WHERE NOT list_contains(path, unit)),
    whole AS (SELECT area_id, CASE WHEN s IS NULL THEN [] ELSE [s] END || path || CASE WHEN e IS NULL THEN [] ELSE [e] END AS path FROM paths JOIN n USING (area_id) WHERE len(path) = n),
    steps AS (SELECT area_id, path, unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM whole WHERE len(path) > 1),
    score AS (SELECT s.area_id, path, sum(CASE WHEN b = a + 1 THEN 1 ELSE 0 END + CASE WHEN x.tail IS NULL OR y.head IS NULL THEN 0 ELSE {_PULL.format(a="x.tail[1]", b="y.head[1]")} + {_PULL.format(a="x.tail[2]", b="y.head[2]")} END) AS score FROM steps s JOIN units x ON x.unit = a JOIN units y ON y.unit = b GROUP BY ALL),
    best AS (SELECT area_id, path, coalesce(score, 0) AS score FROM whole LEFT JOIN score USING (area_id, path) QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY coalesce(score, 0) DESC, path) = 1)
    SELECT area_id, array_to_string(list_transform(path, lambda p: CAST(p AS VARCHAR)), ',') AS "order", CAST(score AS INT) AS score FROM best""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda c, k, n: F.substring(F.lit(_LETTERS), 1, 6).substr((F.col(c) % k + n).cast("int"), F.lit(1))
    o = F.col("o_orderkey")
    units = table(spark, folder, "orders").select(
        F.floor(o / 5).alias("area_id"), o.cast("long").alias("unit"), (o * 1000).cast("long").alias("start"), F.when(o % 11 == 0, "start").when(o % 13 == 0, "end").alias("role"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(key("o_custkey", 6, 1), key("o_custkey", 4, 2))).alias("tail"), F.when(F.col("o_custkey") % 7 > 0, F.concat(key("o_custkey", 5, 1), key("o_custkey", 3, 1))).alias("head"), (o + 1).cast("long").alias("follower"),
    )
    return ops.best_order(units).select("area_id", F.array_join(F.transform("order", lambda u: u.cast("string")), ",").alias("order"), "score")


#: Every second region is a reference; functions and profiles follow from the genes' numbers, and some areas have none.
_TUPLES = f"""{_SEQ}, {_walk("walk", "s")}, {_LAST}, named AS (SELECT w.id, w.m, string_agg(regexp_replace(profile, '^Condensation_.*', 'Condensation'), '|' ORDER BY w.i) AS value FROM walk w JOIN s USING (id, i) WHERE NOT skip GROUP BY ALL),
    pieces AS (SELECT region, CASE WHEN kind IN ('nrps', 'pks') THEN kind ELSE 'generic' END AS kind, value FROM props JOIN named USING (id, m) JOIN lines ON lines.gene_id = props.gene_id WHERE complete
        UNION ALL SELECT region, 'profile', 'p' || gene_id % 7 FROM lines WHERE region % 5 > 0 AND gene_id % 3 = 0 UNION ALL SELECT region, 'function', 'f' || gene_id % 4 FROM lines WHERE gene_id % 4 > 0 AND region % 7 > 0),
    counted AS (SELECT region, kind, value, count(*) AS n FROM pieces GROUP BY ALL)"""


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lines")
    tuples = ops.complete_modules(table(spark, folder, "domains")).join(lines.select("gene_id", "region"), "gene_id").select("region", "kind", "value")
    profiles = lines.where("region % 5 > 0 and gene_id % 3 = 0").select("region", F.lit("profile").alias("kind"), F.concat(F.lit("p"), F.col("gene_id") % 7).alias("value"))
    functions = lines.where("region % 7 > 0").select("region", F.lit("function").alias("kind"), F.when(F.col("gene_id") % 4 == 0, "other").otherwise(F.concat(F.lit("f"), F.col("gene_id") % 4)).alias("value"))
    return compare_ops.components_of(tuples.unionByName(profiles).unionByName(functions), ["region"])


@query("G10_module_tuples", with_tables(f", {_TUPLES} SELECT * FROM counted", "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _share(kind: str) -> str:
    return f"""CASE WHEN r_{kind} = 0 THEN CASE WHEN mode = 'query_in_reference' THEN 0.0 ELSE 1.0 END WHEN q_{kind} = 0 THEN CASE WHEN mode = 'reference_in_query' THEN 0.0 ELSE 1.0 END ELSE s_{kind} / CASE WHEN mode = 'reference_in_query' THEN r_{kind} ELSE q_{kind} END END AS {kind}"""


_side = lambda a, b: f"CASE mode WHEN 'reference_in_query' THEN {b} WHEN 'query_in_reference' THEN {a} ELSE least({a}, {b}) END"
_SIMILAR = f""", {_TUPLES}, pairs AS (SELECT region, region + d AS ref_area FROM (SELECT DISTINCT region FROM lines WHERE region % 2 = 0), (VALUES (1), (3), (11), (100001)) v(d)),
    sized AS (SELECT region, {", ".join(f"sum(n) FILTER (kind = '{k}') AS {k}" for k in compare_ops.KINDS)} FROM counted GROUP BY region),
    shared AS (SELECT p.region, p.ref_area, {", ".join(f"sum(least(a.n, b.n)) FILTER (a.kind = '{k}') AS {k}" for k in compare_ops.KINDS)} FROM pairs p JOIN counted a ON a.region = p.region JOIN counted b ON b.region = p.ref_area AND b.kind = a.kind AND b.value = a.value GROUP BY ALL),
    sides AS (SELECT p.*, mode, {", ".join(f"coalesce(q.{k}, 0) AS q_{k}, coalesce(r.{k}, 0) AS r_{k}, coalesce(s.{k}, 0) AS s_{k}" for k in compare_ops.KINDS)} FROM pairs p LEFT JOIN sized q ON q.region = p.region LEFT JOIN sized r ON r.region = p.ref_area LEFT JOIN shared s ON s.region = p.region AND s.ref_area = p.ref_area, (VALUES ('best'), ('query_in_reference'), ('reference_in_query')) m(mode)),
    shares AS (SELECT *, {", ".join(map(_share, compare_ops.KINDS))}, {_side("q_nrps + q_pks + q_generic", "r_nrps + r_pks + r_generic")} AS most FROM sides),
    weighed AS (SELECT *, CASE WHEN most > 0 THEN ({" + ".join(f"{k} * ({_side(f'q_{k}', f'r_{k}')})" for k in compare_ops.MODULES)}) / most END AS modules FROM shares)
    SELECT region, ref_area, mode, round(CAST(modules AS DOUBLE), 9) AS modules, round(CAST(profile AS DOUBLE), 9) AS profiles, round(CAST("function" AS DOUBLE), 9) AS functions,
        CASE WHEN mode = 'query_in_reference' OR r_nrps + r_pks + r_profile > 0 THEN round(CAST(CASE WHEN modules IS NULL THEN (profile + "function") / 2 ELSE (modules + profile + "function") / 3 END AS DOUBLE), 9) END AS component_score FROM weighed"""


@query("G11_component_similarity", with_tables(_SIMILAR, "domains", "lines", recursive=True))
def _(spark: SparkSession, folder: str) -> DataFrame:
    parts = cut(_pieces(spark, folder))
    regions = table(spark, folder, "lines").where("region % 2 = 0").select("region").distinct()
    pairs = cut(regions.select("region", F.explode(F.array(*[F.col("region") + d for d in (1, 3, 11, 100_001)])).alias("ref_area")))
    every = compare_ops.similarity_by_modes(pairs, parts, parts.withColumnRenamed("region", "ref_area"), ("best", "query_in_reference", "reference_in_query"))
    return every.select("region", "ref_area", "mode", *[F.round(c, 9).alias(c) for c in ("modules", "profiles", "functions", "component_score")])

"""Queries on sequence scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as chunk_ops
from ..operators import scans as ops
from ..registry import query
from ..tables import table, with_tables
from .areas import _REGIONS, plain_areas, plain_regions
from .areas import ops as areas_ops

_RC = "translate(reverse(seq), 'ACGT', 'TGCA')"
_PROTEIN = "upper(regexp_replace(lower(seq), '[^acdefghiklmnpqrstvwy]', '', 'g'))"


def _dna(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nucleotides")


def _proteins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sequences")
    return rows.select("record_id", F.upper(F.regexp_replace(F.lower("seq"), "[^acdefghiklmnpqrstvwy]", "")).alias("seq"))


@query("H1_gc_content", with_tables("SELECT record_id, CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq) ELSE 0 END AS gc FROM nucleotides", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _dna(spark, folder).select("record_id", ops.gc_content().alias("gc"))


_MEMBERS = """, m AS (SELECT r.record_id, r.region AS area_id, gene_id, g."start", g."end", r."start" AS low, r."end" AS high FROM regions r JOIN genes g ON g.record_id = r.record_id AND r."start" <= g."start" AND g."end" <= r."end"),
    x AS (SELECT *, max("end") OVER (PARTITION BY record_id, area_id ORDER BY "start", "end", gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 20 AS reach FROM m),
    gaps AS (SELECT record_id, area_id, greatest(low, coalesce(reach, low)) AS "start", least(high, "start" + 20) AS "end" FROM x UNION ALL SELECT record_id, region, greatest(r."start", coalesce((SELECT max("end") - 20 FROM m WHERE m.record_id = r.record_id AND m.area_id = r.region), r."start")), r."end" FROM regions r)"""


@query("H2_intergenic", with_tables(f'{_REGIONS}{_MEMBERS} SELECT * FROM gaps WHERE "end" - "start" >= 100', "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    if (dealt := plain_regions(spark, folder)) is not None:
        return ops.intergenic_of(dealt, 100, 20)
    regions = areas_ops.regions(plain_areas(spark, folder)).withColumnRenamed("region", "area_id").select("record_id", "area_id", "start", "end")
    genes = table(spark, folder, "genes").select("record_id", "gene_id", "start", "end")
    inside = areas_ops.range_join(regions, genes, ["record_id"], 20000, how="contain").select("record_id", F.col("l.area_id").alias("area_id"), F.col("r.gene_id").alias("gene_id"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    return ops.intergenic(inside, regions, 100, 20)


_ORFS_SQL = with_tables(f""", b AS (SELECT record_id, length(seq) AS size, unnest([1, -1]) AS strand, unnest([seq, {_RC}]) AS s FROM nucleotides WHERE length(seq) >= 3),
    c AS (SELECT record_id, strand, size, at_, at_ % 3 AS frame, substr(s, at_ + 1, 3) AS codon FROM (SELECT *, unnest(range(0, size - 2)) AS at_ FROM b)),
    d AS (SELECT *, codon IN ('TAA', 'TAG', 'TGA') AS stop FROM c WHERE codon IN ('ATG', 'GTG', 'TTG', 'TAA', 'TAG', 'TGA')),
    e AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY record_id, strand, frame ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM d),
    f AS (SELECT record_id, strand, size, min(at_) FILTER (NOT stop) AS first, max(at_) FILTER (stop) AS last FROM e GROUP BY record_id, strand, size, frame, k)
    SELECT record_id, strand, CAST(CASE WHEN strand = 1 THEN first ELSE size - last - 3 END AS INT) AS "start", CAST(CASE WHEN strand = 1 THEN last + 3 ELSE size - first END AS INT) AS "end" FROM f WHERE last + 2 - first >= 60""", "nucleotides")


@query("H3_scan_orfs", _ORFS_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scan_orfs(_dna(spark, folder))


@query("H3_long_orfs", _ORFS_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows from pieces of 1,000 bases."""
    return chunk_ops.scan_long_orfs(_dna(spark, folder), size=1000)


@query("H4_trim_orfs", with_tables("""SELECT record_id, list_max(list_filter(range(0, length(seq) - 2, 3), lambda k: substr(seq, CAST(k AS INT) + 1, 3) IN ('ATG', 'GTG', 'TTG') AND k <= 300 AND length(seq) - k BETWEEN 60 AND 3000)) AS latest FROM nucleotides""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _dna(spark, folder).select("record_id", ops.trim_orf(F.col("seq"), F.lit(300), 60, 3000).cast("long").alias("latest"))


_CODE = "MAP {" + ", ".join(f"'{c}': '{r}'" for c, r in ops.CODONS.items()) + "}"


@query("H5_translate", with_tables(f""", t AS (SELECT record_id, coalesce(array_to_string(list_transform(range(0, CAST(floor(length(seq) / 3) AS BIGINT)), lambda k: coalesce({_CODE}[substr(seq, CAST(k AS INT) * 3 + 1, 3)], 'X')), ''), '') AS r FROM nucleotides)
    SELECT record_id, md5(CASE WHEN split_part(r, '*', 1) = '' THEN replace(r, '*', '') ELSE split_part(r, '*', 1) END) AS digest FROM t""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _dna(spark, folder).select("record_id", F.md5(ops.translate(F.col("seq"))).alias("digest"))


@query("H5_new_frames", with_tables(f""", t AS (SELECT record_id, coalesce(array_to_string(list_transform(range(0, CAST(floor(length(seq) / 3) AS BIGINT)), lambda k: coalesce({_CODE}[substr(seq, CAST(k AS INT) * 3 + 1, 3)], 'X')), ''), '') AS r FROM nucleotides),
    h AS (SELECT record_id, CASE WHEN split_part(r, '*', 1) = '' THEN replace(r, '*', '') ELSE split_part(r, '*', 1) END AS p FROM t) SELECT record_id, length(p) AS n, md5(regexp_replace(p, '^.', 'M')) AS digest FROM h""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    residues = ops.translate(F.col("seq"), new_frame=True)
    return _dna(spark, folder).select("record_id", F.length(residues).cast("long").alias("n"), F.md5(residues).alias("digest"))


@query("H6_codon_positions", with_tables("""SELECT record_id, record_id AS gene_id, CAST(k AS INT) AS position FROM (SELECT *, unnest(range(0, length(seq) - 2, 3)) AS k FROM nucleotides WHERE length(seq) > 0 AND length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq) >= 0.4) WHERE substr(seq, CAST(k AS INT) + 1, 3) = 'TTA'""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    genes = _dna(spark, folder).select("record_id", F.col("record_id").alias("gene_id"), "seq", ops.gc_content().alias("gc"))
    return ops.codon_positions(genes, "tta", 0.4)


#: Two small weight matrices.
MATRICES = {"box": [{"A": 0.9, "C": -0.4, "G": 0.1, "T": -1.2}, {"A": -0.7, "C": 1.1, "G": -0.2, "T": 0.3}, {"A": 1.3, "C": -0.9, "G": 0.2, "T": -0.5}, {"A": -1.1, "C": 0.4, "G": 0.8, "T": 0.6}], "site": [{"A": -0.5, "C": 0.2, "G": 1.4, "T": -0.3}, {"A": 0.7, "C": 0.1, "G": -0.8, "T": 0.9}, {"A": 0.3, "C": -1.0, "G": 0.6, "T": 1.2}]}
THRESHOLDS = {"box": 3.9, "site": 3.4}


def _matrix_sql(name: str) -> str:
    weights = MATRICES[name]
    size = len(weights)
    score = " + ".join("CASE substr(w, {}, 1) ".format(k + 1) + " ".join(f"WHEN '{b}' THEN {c[b]}::DOUBLE" for b in "ACGT") + f" ELSE {min(c.values())}::DOUBLE END" for k, c in enumerate(weights))
    return f"""SELECT record_id, '{name}' AS matrix, CAST(CASE WHEN strand = 1 THEN k ELSE size - k - {size} END AS INT) AS "start", strand, round({score}, 6) AS score FROM (SELECT *, substr(s, CAST(k AS INT) + 1, {size}) AS w FROM (SELECT *, unnest(range(0, size - {size - 1})) AS k FROM b WHERE size >= {size})) WHERE round({score}, 6) >= {THRESHOLDS[name]}"""


_HITS_SQL = f""", b AS (SELECT record_id, length(seq) AS size, unnest([1, -1]) AS strand, unnest([seq, {_RC}]) AS s FROM nucleotides), found AS ({_matrix_sql("box")} UNION ALL {_matrix_sql("site")})"""


@query("H7_scan_matrices", with_tables(f"{_HITS_SQL} SELECT * FROM found", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scan_matrices(_dna(spark, folder), MATRICES, THRESHOLDS)


@query("H7_long_matrices", with_tables(f"{_HITS_SQL} SELECT * FROM found", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows from pieces of 1,000 bases."""
    return chunk_ops.scan_long_matrices(_dna(spark, folder), MATRICES, THRESHOLDS, 1000)


@query("H8_confidence", with_tables(f"""{_HITS_SQL} SELECT matrix, CASE WHEN score <= 4.0 THEN 'weak' WHEN score >= 4.2 THEN 'strong' ELSE 'medium' END AS confidence, count(*) AS n FROM found WHERE matrix = 'box' GROUP BY ALL""", "nucleotides"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.scan_matrices(_dna(spark, folder), {"box": MATRICES["box"]}, THRESHOLDS)
    return found.groupBy("matrix", ops.confidence(F.col("score"), F.lit(4.0), F.lit(4.4)).alias("confidence")).agg(F.count("*").alias("n"))


@query("H9_binding_areas", with_tables("""SELECT record_id, low AS "start", high AS "end" FROM (SELECT record_id, CASE WHEN ps = -1 THEN pe - 50 ELSE pe END AS low, CASE WHEN strand = 1 THEN "start" + 50 ELSE "start" END AS high FROM (SELECT *, lag("end") OVER w AS pe, lag(strand) OVER w AS ps FROM genes WINDOW w AS (PARTITION BY record_id ORDER BY "start", "end", gene_id))
    WHERE pe IS NOT NULL AND NOT (ps = 1 AND strand = -1)) WHERE low < high""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.binding_areas(table(spark, folder, "genes"))


_ALIGNED = f"""aligned AS (SELECT record_id, p AS query, substr(p, 4, 1) || '--' || substr(p, 5) AS reference FROM (SELECT record_id, {_PROTEIN} AS p FROM sequences))"""


@query("H10_extract_signature", with_tables(f""", {_ALIGNED}, l AS (SELECT record_id, string_split(query, '') AS q, string_split(reference, '') AS r, least(length(query), length(reference)) AS size FROM aligned),
    k AS (SELECT record_id, q, list_filter(range(1, size + 1), lambda i: r[i] <> '-') AS cols FROM l)
    SELECT record_id, CASE WHEN len(cols) > 20 THEN q[cols[3]] || q[cols[8]] || q[cols[21]] END AS signature FROM k""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proteins(spark, folder).withColumn("reference", F.concat(F.substring("seq", 4, 1), F.lit("--"), F.expr("substr(seq, 5)")))
    return rows.select("record_id", ops.extract_signature(F.col("seq"), F.col("reference"), [2, 7, 20]).alias("signature"))


REFERENCES = [("red", "THEANDTI"), ("red", "THATISAN"), ("blue", "ERNTHAED"), ("blue", "LEDESQVE"), ("green", "DERDIEND")]
_REFERENCES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REFERENCES) + ") refs(label, ref_sig)"


@query("H11_signature_similarity", with_tables(f""", s AS (SELECT record_id AS query_id, substr({_PROTEIN}, 1, 8) AS sig FROM sequences)
    SELECT query_id, label, max(100.0 * m / 8) AS similarity FROM (SELECT query_id, label, len(list_filter(range(1, 9), lambda k: sig[k] = ref_sig[k])) AS m FROM s, {_REFERENCES_SQL} WHERE length(sig) = 8) WHERE 100.0 * m / 8 > 20 GROUP BY ALL""".replace("max(100.0 * m / 8)", "CAST(max(100.0 * m / 8) AS DOUBLE)"), "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    queries = _proteins(spark, folder).select(F.col("record_id").alias("query_id"), F.substring("seq", 1, 8).alias("signature"))
    return ops.signature_similarity(queries, spark.createDataFrame(REFERENCES, "label string, ref_sig string"), 20.0)


KINDS = [("active", {0: "TE", 2: "EAN"}), ("d-form", {1: "AH"}), ("l-form", {1: "EIO", 3: "RNT"})]


@query("H12_classify_signature", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS g FROM sequences) SELECT record_id, CASE WHEN g[1] IN ('T', 'E') AND g[3] IN ('E', 'A', 'N') THEN 'active' WHEN g[2] IN ('A', 'H') THEN 'd-form' WHEN g[2] IN ('E', 'I', 'O') AND g[4] IN ('R', 'N', 'T') THEN 'l-form' ELSE 'unknown' END AS kind FROM s""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _proteins(spark, folder).select("record_id", ops.classify_signature(F.col("seq"), KINDS, "unknown").alias("kind"))


@query("H16_trim_alignment", with_tables(f""", r AS (SELECT record_id % 40 AS alignment_id, string_split(CASE record_id % 3 WHEN 0 THEN '--' || {_PROTEIN} ELSE {_PROTEIN} || '----' END, '') AS a FROM sequences),
    c AS (SELECT alignment_id, k, a[k] AS letter FROM (SELECT *, unnest(range(1, len(a) + 1)) AS k FROM r)), n AS (SELECT alignment_id, k, letter, count(*) AS n FROM c GROUP BY ALL),
    t AS (SELECT alignment_id, k, max((n, letter)) AS top FROM n GROUP BY ALL), z AS (SELECT alignment_id, count(*) AS rows FROM r GROUP BY ALL)
    SELECT alignment_id, CAST(min(k) - 1 AS INT) AS first, CAST(max(k) - 1 AS INT) AS last FROM t JOIN z USING (alignment_id) WHERE top[2] <> '-' AND top[1] >= rows * 0.2 GROUP BY alignment_id""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    aligned = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("--"), F.col("seq"))).otherwise(F.concat(F.col("seq"), F.lit("----")))
    return ops.trim_alignment(_proteins(spark, folder).select((F.col("record_id") % 40).alias("alignment_id"), aligned.alias("aligned")), 0.2)


@query("H17_cleavage_site", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS p FROM sequences), h AS (SELECT record_id, p, length(regexp_extract(p, '(?s)^(.*(?:G[AG]))', 1)) AS a, length(regexp_extract(p, '(?s)^(.*(?:T.R))', 1)) AS b FROM s)
    SELECT record_id, CAST(coalesce(CASE WHEN a > 0 AND length(p) - a >= 10 THEN a END, CASE WHEN b > 0 AND length(p) - (b + 2) >= 10 THEN b + 2 END) AS INT) AS site FROM h""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _proteins(spark, folder).select("record_id", ops.cleavage_site(F.col("seq"), [("G[AG]", 0), ("T.R", 2)], 10).alias("site"))


CLASSES = {"small": "AGST", "charged": "DEKR", "aromatic": "FWYH"}


@query("H18_peptide_features", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS p FROM sequences), c AS (SELECT record_id, p, list_filter(range(1, len(l) + 1), lambda k: l[k] = 'C') AS cs FROM (SELECT *, string_split(p, '') AS l FROM s))
    SELECT record_id, CAST(length(p) AS INT) AS length, {", ".join(f"CAST(length(regexp_replace(p, '[^{letters}]', '', 'g')) AS INT) AS n_{name}" for name, letters in CLASSES.items())},
    CAST(len(list_filter(cs, lambda k: list_contains(cs, k + 2) OR list_contains(cs, k + 3) OR list_contains(cs, k + 4) OR list_contains(cs, k + 5))) AS INT) AS n_facing_cys FROM c""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _proteins(spark, folder).select("record_id", *ops.peptide_features(F.col("seq"), CLASSES))


@query("H19_heuristic_score", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS p FROM sequences)
    SELECT record_id, CAST(CASE WHEN length(p) BETWEEN 20 AND 90 THEN 3 ELSE 0 END + CASE WHEN contains(p, 'CC') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(p, 'S.C') THEN 2 ELSE 0 END + CASE WHEN starts_with(p, 'T') THEN -1 ELSE 0 END AS INT) AS score FROM s""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("seq")
    weights = [(F.length(p).between(20, 90), 3), (p.contains("CC"), 5), (p.rlike("S.C"), 2), (p.startswith("T"), -1)]
    return _proteins(spark, folder).select("record_id", ops.heuristic_score(weights).alias("score"))


_MASS = f"{ops.WATER} + " + " + ".join(f"(length(p) - length(replace(p, '{r}', ''))) * {m}::DOUBLE" for r, m in ops.MASSES.items())


@query("H20_peptide_mass", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS p FROM sequences), m AS (SELECT record_id, {_MASS} AS mass, length(p) - length(replace(p, 'S', '')) AS n FROM s)
    SELECT record_id, round(mass, 3) AS mass, coalesce(array_to_string(list_transform(range(1, n + 1), lambda k: CAST((CAST(round((mass + k * {ops.WATER}) * 10000) AS BIGINT) + 5000) // 10000 AS VARCHAR)), ','), '') AS others FROM m""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _proteins(spark, folder)
    measured = rows.select("record_id", ops.peptide_mass(F.col("seq")).alias("whole"), (F.length("seq") - F.length(F.replace("seq", F.lit("S"), F.lit("")))).alias("n"))
    others = F.transform(ops.alternative_masses(F.col("whole"), F.col("n")), lambda m: F.call_function("div", F.round(m * 10000).cast("long") + 5000, F.lit(10000)).cast("string"))
    return measured.select("record_id", F.round("whole", 3).alias("mass"), F.array_join(others, ",").alias("others"))


@query("H21_peptide_class", with_tables("""SELECT record_id, CASE WHEN list_contains(p, 'click') AND list_contains(p, 'purchase') THEN 'one' WHEN list_contains(p, 'error') THEN 'two' ELSE 'unknown' END AS class FROM (SELECT record_id * 100 + "start" // 86400 AS record_id, list(DISTINCT profile) AS p FROM moments GROUP BY 1)""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "moments").withColumn("record_id", F.expr("record_id * 100 + start div 86400")).groupBy("record_id").agg(F.collect_set("profile").alias("p"))
    return rows.select("record_id", ops.peptide_class(F.col("p"), [("one", ["click", "purchase"]), ("two", ["error"])]).alias("class"))


@query("F24_approx_pattern", with_tables(f""", s AS (SELECT record_id, {_PROTEIN} AS p FROM sequences), k AS (SELECT record_id, p, unnest(range(0, least(length(p) - 8, 49) + 1)) AS i FROM s WHERE length(p) >= 8)
    SELECT record_id, CAST(i AS INT) AS "start", fit / 6 AS score FROM (SELECT record_id, i, {" + ".join(f"CASE WHEN p[i + {k + 1}] = '{c}' THEN 1 ELSE 0 END" for k, c in enumerate("TH.AN.ED") if c != ".")} AS fit FROM k) WHERE fit >= 4""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.approx_pattern(_proteins(spark, folder), "TH.AN.ED", 2)


@query("F25_regex_detector", with_tables("SELECT record_id FROM sequences WHERE length(seq) BETWEEN 200 AND 3000 AND regexp_matches(seq, 'th[aeiou]+n.*ed')", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.regex_detector(table(spark, folder, "sequences"), "th[aeiou]+n.*ed", 200, 3000).select("record_id")



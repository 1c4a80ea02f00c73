"""Queries on cleaning, and on locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locations as loc
from ..operators import clean as ops
from ..plans.ordering import with_adjacent
from ..registry import query
from ..tables import table, with_tables


def _sequences(spark: SparkSession, folder: str, name: str = "sequences") -> DataFrame:
    return table(spark, folder, name).withColumns({"idx": F.col("record_id"), "skip_reason": F.lit(None).cast("string")})


@query("B1_sanitise", with_tables("""SELECT record_id, md5(s) AS digest, CASE WHEN NOT regexp_matches(s, '[ACGT]') THEN 'contains no sequence' END AS skip_reason
    FROM (SELECT record_id, regexp_replace(replace(upper(replace(seq, 'ß', 'SS')), '-', ''), '[^ACGT]', 'N', 'g') AS s FROM sequences)""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.sanitise(_sequences(spark, folder)).select("record_id", F.md5("seq").alias("digest"), "skip_reason")


@query("B2_nucleotide_check", with_tables("SELECT record_id, CASE WHEN length(seq) > 0 THEN length(regexp_replace(lower(seq), '[^acgtn-]', '', 'g')) / length(seq) ELSE 0 END >= 0.3 AS is_nucleotide FROM sequences", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.looks_nucleotide(_sequences(spark, folder), 0.3).select("record_id", "is_nucleotide")


@query("B3_mark_short", with_tables("SELECT record_id, CASE WHEN length(seq) < 1000 THEN 'smaller than minimum length (1000)' END AS skip_reason FROM sequences", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.mark_short(_sequences(spark, folder)).select("record_id", "skip_reason")


@query("B4_limit_to_record", with_tables("SELECT record_id, CASE WHEN record_id <> 7 THEN 'did not match the record to be kept' END AS skip_reason FROM sequences", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.limit_to_record(_sequences(spark, folder), 7).select("record_id", "skip_reason")


@query("B5_limit_largest", with_tables("SELECT record_id, CASE WHEN row_number() OVER (ORDER BY length(seq) DESC, record_id) > 50 THEN 'skipping all but largest 50 records' END AS skip_reason FROM sequences", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.limit_largest(_sequences(spark, folder), 50).select("record_id", "skip_reason")


@query("B6_trim", with_tables("""SELECT record_id, gene_id, "start" - 86400 AS "start", "end" - 86400 AS "end" FROM moments WHERE "start" >= 86400 AND "end" <= 864000""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.trim(_sequences(spark, folder), table(spark, folder, "moments"), 86400, 864000)[1].select("record_id", "gene_id", "start", "end")


_NAME = """CASE record_id % 7 WHEN 0 THEN 'contig' || (record_id % 50) || ' of (a) long assembly' WHEN 1 THEN 'rec=' || (record_id % 20) WHEN 2 THEN 'rec' || (record_id % 20) || '_' || (record_id % 3)
    WHEN 3 THEN 'NZ_AMZN' || lpad(CAST(record_id % 80 AS VARCHAR), 8, '0') || '.' || (record_id % 2 + 1) WHEN 4 THEN 'scaffold:' || record_id || '_of_assembly' WHEN 5 THEN 'a long name without number ' || (record_id % 4) ELSE 'plain' END"""
_NUMBER = "coalesce(TRY_CAST(nullif(regexp_extract(id, 'onti?g?(\\d+)\\b', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(id, 'caff?o?l?d?(\\d+)\\b', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(id, '\\bc(\\d+)\\b', 1), '') AS BIGINT), record_id + 1)"


def _numbering(name: str, rows: str, taken: str) -> str:
    """Common table expressions: ``name`` has ``record_id, id`` of ``rows`` (``record_id, stem``) with the least numbers not in ``taken``."""
    return f"""{name}_r AS (SELECT record_id, stem, row_number() OVER (PARTITION BY stem ORDER BY record_id) AS k FROM ({rows})),
    {name}_n AS (SELECT stem, unnest(range(0, 2000)) AS i FROM (SELECT DISTINCT stem FROM {name}_r)),
    {name}_f AS (SELECT stem, i, row_number() OVER (PARTITION BY stem ORDER BY i) AS k FROM {name}_n WHERE stem || '_' || i NOT IN ({taken})),
    {name} AS (SELECT record_id, stem || '_' || i AS id FROM {name}_r JOIN {name}_f USING (stem, k))"""


@query("B7_normalise_ids", with_tables(f""", g AS (SELECT record_id, translate({_NAME}, '!"#$%&()*+,:;=>?@[]^`''{{|}}/ ', '') AS id FROM sequences),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_id) AS k FROM g),
    {_numbering("dup", "SELECT record_id, id AS stem FROM o WHERE k > 1", "SELECT id FROM g")},
    u AS (SELECT record_id, id FROM o WHERE k = 1 UNION ALL SELECT * FROM dup), long AS (SELECT * FROM u WHERE length(id) > 16),
    v AS (SELECT min(record_id) AS record_id, split_part(id, '.', 1) AS new_id FROM long WHERE regexp_matches(id, '^[^.]{{1,16}}\\.[^.]$') AND split_part(id, '.', 1) NOT IN (SELECT id FROM u) GROUP BY 2),
    w AS (SELECT *, 'c' || CASE WHEN num < 100000 THEN lpad(CAST(num AS VARCHAR), 5, '0') ELSE CAST(num AS VARCHAR) END || '_' || id[1:7] || '..' AS short FROM (SELECT *, {_NUMBER} AS num FROM long WHERE record_id NOT IN (SELECT record_id FROM v))),
    x AS (SELECT min(record_id) AS record_id, short AS new_id FROM w WHERE short NOT IN (SELECT id FROM u) GROUP BY short),
    {_numbering("last", "SELECT record_id, id[1:12] AS stem FROM w WHERE record_id NOT IN (SELECT record_id FROM x)", "SELECT id FROM u UNION ALL SELECT new_id FROM v")},
    changed AS (SELECT * FROM v UNION ALL SELECT * FROM x UNION ALL SELECT record_id, id FROM last)
    SELECT record_id, coalesce(new_id, id) AS new_id FROM u LEFT JOIN changed USING (record_id)""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    named = _sequences(spark, folder).withColumn("name", F.expr(_NAME.replace("VARCHAR", "STRING")))
    return ops.normalise_ids(named).select("record_id", "new_id")


@query("B8_strip_annotations", with_tables("""SELECT record_id, gene_id, CASE WHEN gene_id % 2 = 0 THEN 'note' ELSE '' END AS keys FROM moments WHERE profile NOT IN ('error', 'view')""", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "moments").select("record_id", "gene_id", F.col("profile").alias("type"), F.when(F.col("gene_id") % 2 == 0, F.create_map(F.lit("note"), F.array(F.lit("x")), F.lit("tool"), F.array(F.lit("y")))).otherwise(F.create_map(F.lit("tool"), F.array(F.lit("y")))).alias("qualifiers"))
    return ops.strip_annotations(features, ["error", "view"], ["tool"]).select("record_id", "gene_id", F.array_join(F.map_keys("qualifiers"), ",").alias("keys"))


#: Three exons per gene, some out of order, some with a shared stop.
_EXONS = """exons AS (SELECT record_id, gene_id AS feature_id, "start" AS s, CASE gene_id % 4 WHEN 0 THEN ["start", "start" + 300, "start" + 200] WHEN 1 THEN ["start", "start" + 60, "start" + 200] ELSE ["start", "start" + 100, "start" + 200] END AS starts,
    CASE gene_id % 4 WHEN 0 THEN ["start" + 50, "start" + 350, "start" + 250] WHEN 1 THEN ["start" + 120, "start" + 120, "start" + 250] ELSE ["start" + 50, "start" + 150, "start" + 250] END AS ends FROM genes)"""


def exons(spark: SparkSession, folder: str) -> DataFrame:
    """The same in Spark, as ``parts``."""
    start, kind = F.col("start"), F.col("gene_id") % 4
    shape = lambda *spans: F.array(*[loc.part(start + a, start + b, F.lit(1)) for a, b in spans])
    parts = F.when(kind == 0, shape((0, 50), (300, 350), (200, 250))).when(kind == 1, shape((0, 120), (60, 120), (200, 250))).otherwise(shape((0, 50), (100, 150), (200, 250)))
    return table(spark, folder, "genes").select("record_id", F.col("gene_id").alias("feature_id"), "strand", parts.alias("parts"))


@query("B9_check_locations", with_tables(f""", {_EXONS}, l AS (SELECT record_id, max("start") + 200 AS length FROM genes GROUP BY record_id)
    SELECT record_id, feature_id, problem FROM (SELECT record_id, feature_id, CASE WHEN list_max(ends) > length THEN 'outside the record' WHEN len(list_distinct(ends)) < 3 THEN 'exons share a stop' WHEN starts <> list_sort(starts) AND starts <> list_reverse_sort(starts) THEN 'inconsistent exon order' END AS problem
    FROM exons JOIN l USING (record_id)) WHERE problem IS NOT NULL""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "genes").groupBy("record_id").agg((F.max("start") + 200).alias("length")).withColumn("circular", F.lit(False))
    return ops.check_locations(exons(spark, folder), lengths)


@query("B15_filter_gene_calls", with_tables("""SELECT record_id, gene_id, "start", "end" FROM (SELECT *, max(CASE WHEN "end" > length THEN "end" - length END) OVER (PARTITION BY record_id) AS over_end FROM genes JOIN (SELECT record_id, CAST(max("end") * 3 // 4 AS BIGINT) AS length FROM genes GROUP BY record_id) USING (record_id) WHERE "start" < length AND "end" - "start" <= 140)
    WHERE over_end IS NULL OR "end" > length OR "end" > over_end""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "genes").select("record_id", "gene_id", "start", "end")
    lengths = calls.groupBy("record_id").agg(F.expr("max(end) * 3 div 4").alias("length"))
    return ops.filter_gene_calls(calls, lengths, 140)


@query("B16_mark_skipped", with_tables("""SELECT record_id, CASE WHEN record_id NOT IN (SELECT record_id FROM moments) THEN 'no genes found' WHEN record_id NOT IN (SELECT record_id FROM moments WHERE score > 200) THEN 'no regions found' END AS skip_reason FROM sequences""", "sequences", "moments"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    moments = table(spark, folder, "moments")
    return ops.mark_skipped(_sequences(spark, folder), moments, moments.where("score > 200")).select("record_id", "skip_reason")


# Locations: the oracles work on hull coordinates or exon lists of the same genes.


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Genes with the next one on their record, both as exons."""
    rows = exons(spark, folder).withColumn("low", F.col("parts")[0]["start"])
    near = with_adjacent(rows, ["record_id"], ["low", "feature_id"], ["parts"])
    return near.withColumn("other", F.col("after.parts")).where("other is not null").drop("before", "after")


_PAIRS = f""", {_EXONS}, p AS (SELECT *, lead(starts) OVER w AS os, lead(ends) OVER w AS oe FROM exons WINDOW w AS (PARTITION BY record_id ORDER BY s, feature_id)),
    q AS (SELECT *, list_filter(range(0, 9), lambda k: starts[k // 3 + 1] < oe[k % 3 + 1] AND os[k % 3 + 1] < ends[k // 3 + 1]) AS hit,
        list_min(list_transform(range(0, 9), lambda k: greatest(0, os[k % 3 + 1] - ends[k // 3 + 1], starts[k // 3 + 1] - oe[k % 3 + 1]))) AS apart FROM p WHERE os IS NOT NULL)"""


@query("C1_overlaps", with_tables(f"{_PAIRS} SELECT record_id, feature_id, len(hit) > 0 AS overlaps FROM q", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("record_id", "feature_id", loc.overlaps(F.col("parts"), F.col("other")).alias("overlaps"))


@query("C2_contains", with_tables(f"{_PAIRS} SELECT record_id, feature_id, len(list_filter([1, 2, 3], lambda j: len(list_filter([1, 2, 3], lambda i: starts[i] - 60 <= os[j] AND oe[j] <= ends[i] + 200)) > 0)) = 3 AS contains FROM q", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    wide = F.transform("parts", lambda p: loc.part(p["start"] - 60, p["end"] + 200))
    return _pairs(spark, folder).select("record_id", "feature_id", loc.contains(wide, F.col("other")).alias("contains"))


@query("C3_distance", with_tables(f"{_PAIRS} SELECT record_id, feature_id, apart AS distance FROM q", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("record_id", "feature_id", loc.distance(F.col("parts"), F.col("other")).alias("distance"))


_CIRCLE = """c AS (SELECT record_id, gene_id, "start" AS s, "end" AS e, CAST(max("end") OVER (PARTITION BY record_id) + 40 AS BIGINT) AS n, record_id % 2 = 0 AS circular FROM genes)"""


def _circle(spark: SparkSession, folder: str) -> DataFrame:
    genes = table(spark, folder, "genes")
    lengths = genes.groupBy("record_id").agg((F.max("end") + 40).alias("length"))
    rows = genes.join(lengths, "record_id").withColumn("circular", F.col("record_id") % 2 == 0)
    return rows.withColumn("parts", F.array(loc.part(F.col("start"), F.col("end"), F.lit(1))))


_TEXT = "CASE WHEN {two} THEN 'join{{[' || {a} || ':' || {b} || '](+), [' || {c} || ':' || {d} || '](+)}}' ELSE '[' || {a} || ':' || {b} || '](+)' END"


@query("C4_extend", with_tables(f""", {_CIRCLE}, x AS (SELECT *, s - 90000 AS low, e + 90000 AS high FROM c)
    SELECT record_id, gene_id, CASE WHEN NOT circular THEN '[' || greatest(0, low) || ':' || least(n, high) || '](+)' WHEN high - low >= n THEN '[0:' || n || '](+)' WHEN low < 0 OR high > n THEN 'join{{[' || ((low % n + n) % n) || ':' || n || '](+), [0:' || (((high - 1) % n + n) % n + 1) || '](+)}}' ELSE '[' || low || ':' || high || '](+)' END AS extended FROM x""".replace("{{", "{").replace("}}", "}"), "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _circle(spark, folder)
    return rows.select("record_id", "gene_id", loc.format_location(loc.extend(F.col("parts"), 90000, F.col("length"), F.col("circular"))).alias("extended"))


@query("C5_hull", with_tables(f""", {_CIRCLE}, g AS (SELECT record_id, gene_id // 1000000 % 5 AS k, n, circular, list((s, e) ORDER BY s, e) AS l FROM c GROUP BY ALL),
    w AS (SELECT *, l[1][1] AS first, list_max(list_transform(l, lambda p: p[2])) AS last, list_transform(range(2, len(l) + 1), lambda i: (l[i][1] - list_max(list_transform(l[:i - 1], lambda p: p[2])), -i)) AS gaps FROM g),
    z AS (SELECT *, list_max(gaps) AS m FROM w)
    SELECT record_id, k, CASE WHEN circular AND len(l) > 1 AND m[1] > first + n - last THEN 'join{{[' || l[-m[2]][1] || ':' || n || '](+), [0:' || list_max(list_transform(l[:-m[2] - 1], lambda p: p[2])) || '](+)}}' ELSE '[' || first || ':' || last || '](+)' END AS hull FROM z""".replace("{{", "{").replace("}}", "}"), "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _circle(spark, folder).withColumn("k", F.expr("gene_id div 1000000 % 5"))
    return loc.hulls(rows, ["record_id", "k"], ["start", "end", "gene_id"]).select("record_id", "k", loc.format_location(F.col("hull")).alias("hull"))


@query("C6_crosses_origin", with_tables(f", {_EXONS} SELECT record_id, feature_id, starts[2] < starts[1] OR starts[3] < starts[2] AS crosses, CASE WHEN starts[3] < starts[2] THEN 2 END AS n_upper FROM exons", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.col("parts")
    crosses = loc.crosses_origin(parts)
    return exons(spark, folder).select("record_id", "feature_id", crosses.alias("crosses"), F.when(crosses, F.size(loc.split_origin(parts)[0])).alias("n_upper"))


@query("C7_offset", with_tables(f""", {_CIRCLE}, x AS (SELECT *, (s + 90000) % n AS a FROM c) SELECT record_id, gene_id, CASE WHEN a + e - s <= n THEN '[' || a || ':' || (a + e - s) || '](+)' ELSE 'join{{[' || a || ':' || n || '](+), [0:' || (a + e - s - n) || '](+)}}' END AS moved, '[' || (s + 2) || ':' || e || '](+)' AS shifted FROM x""".replace("{{", "{").replace("}}", "}"), "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.col("parts")
    return _circle(spark, folder).select("record_id", "gene_id", loc.format_location(loc.offset(parts, 90000, F.col("length"))).alias("moved"), loc.format_location(loc.frameshift(parts, F.lit(3))).alias("shifted"))


@query("C8_protein_to_dna", with_tables(f""", {_EXONS}, k AS (SELECT row_number() OVER () AS rid, record_id, feature_id, CASE WHEN feature_id % 4 = 1 THEN [starts[1], starts[3]] ELSE starts END AS s, CASE WHEN feature_id % 4 = 1 THEN [ends[1], ends[3]] ELSE ends END AS e FROM exons),
    x AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM k),
    y AS (SELECT *, CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: e[j] - s[j])), 0) AS BIGINT) AS before FROM x),
    z AS (SELECT rid, i, s[i] + greatest(30 - before, 0) AS a, s[i] + least(75 - before, e[i] - s[i]) AS b FROM y),
    t AS (SELECT rid, string_agg(a || '-' || b, ',' ORDER BY i) AS spans FROM z WHERE a < b GROUP BY rid)
    SELECT record_id, feature_id, spans FROM k JOIN t USING (rid)""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    # Exons inside larger ones go first; the others count in the order in which they are given, also if that is not along the record.
    found = loc.protein_to_dna(loc.drop_redundant_exons(F.col("parts")), F.lit(10), F.lit(25))
    return exons(spark, folder).select("record_id", "feature_id", F.array_join(F.transform(found, lambda p: F.concat_ws("-", p["start"], p["end"])), ",").alias("spans"))


@query("C9_drop_redundant_exons", with_tables(f", {_EXONS} SELECT record_id, feature_id, CAST(CASE WHEN feature_id % 4 = 1 THEN 2 ELSE 3 END AS INT) AS n FROM exons", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return exons(spark, folder).select("record_id", "feature_id", F.size(loc.drop_redundant_exons(F.col("parts"))).alias("n"))


@query("C10_location_strings", with_tables(f""", {_EXONS} SELECT record_id, feature_id, 'join{{[' || starts[1] || ':' || ends[1] || '](+), [' || starts[2] || ':' || ends[2] || '](+), [' || starts[3] || ':' || ends[3] || '](+)}}' AS written, true AS same FROM exons""".replace("{{", "{").replace("}}", "}"), "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    # Written in a step of its own, so that what is read back is not written again.
    rows = exons(spark, folder).withColumn("written", loc.format_location(F.col("parts")))
    return rows.select("record_id", "feature_id", "written", (loc.parse_location(F.col("written")) == F.col("parts")).alias("same"))


@query("C11_order_key", with_tables(f""", {_EXONS} SELECT record_id, feature_id, CASE WHEN starts[3] < starts[2] THEN -(ends[1] - starts[1] + ends[2] - starts[2]) ELSE list_min(starts) END AS a, CASE WHEN starts[3] < starts[2] THEN ends[3] ELSE list_max(ends) END AS b FROM exons""", "genes"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    key = loc.order_key(F.col("parts"))
    return exons(spark, folder).select("record_id", "feature_id", key["a"].alias("a"), key["b"].alias("b"))

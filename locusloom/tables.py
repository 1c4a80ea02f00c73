"""Canonical tables, bound to the star schema and event tables that the queries run on.

``SQL`` has the same definitions for the oracles, as the bodies of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLACE = "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey"

_ANY = "PKS_KS PKS_AT PKS_DH PKS_ER PKS_KR ACP PCP PKS_PP AMP-binding A-OX Condensation_LCL Condensation_Starter Heterocyclization Epimerization Thioesterase TD CAL_domain SAT cMT nMT Trans-AT_docking TIGR01720 ECH Interface PKS_Docking_Nterm LPG_synthase_C Beta_elim_lyase oMT"
_PATTERNS = ("PKS_KS PKS_AT PKS_KR ACP PKS_KS PKS_AT ACP", "Condensation_LCL AMP-binding PCP Condensation_LCL AMP-binding PCP Thioesterase", "PKS_KS Trans-AT_docking ACP PKS_KR PKS_KS PCP LPG_synthase_C")

SQL: dict[str, str] = {
    # Genes on long records: one per line item, a supplier's items on one axis.
    "genes": f"""SELECT CAST(l_suppkey AS BIGINT) AS record_id, CAST({_PLACE} AS BIGINT) AS gene_id,
        CAST(l_orderkey * 100 + l_linenumber * 7 AS BIGINT) AS "start", CAST(l_orderkey * 100 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) * 3 AS BIGINT) AS "end",
        CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, concat(l_returnflag, l_linestatus) AS profile, l_extendedprice AS score FROM lineitem""",
    # Hits on proteins: several per gene.
    "hits": f"""SELECT CAST(l_suppkey AS BIGINT) AS record_id, CAST(l_suppkey * 100 + l_orderkey % 100 AS BIGINT) AS gene_id, concat(l_returnflag, l_linestatus) AS profile,
        CAST((l_partkey * 13 + l_linenumber * 37) % 500 AS BIGINT) AS "start", CAST((l_partkey * 13 + l_linenumber * 37) % 500 + 10 + CAST(l_quantity AS BIGINT) AS BIGINT) AS "end",
        l_extendedprice AS score, l_discount AS evalue, CAST({_PLACE} AS BIGINT) AS ord FROM lineitem""",
    # Genes on a time axis, in seconds: a user's events.
    "moments": """SELECT CAST(user_id AS BIGINT) AS record_id, CAST(event_id AS BIGINT) AS gene_id, CAST({seconds} AS BIGINT) AS "start",
        CAST({seconds} + 1 + CAST(floor(value) AS BIGINT) AS BIGINT) AS "end", CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS strand, event_type AS profile, value AS score FROM events""",
    "sequences": """SELECT CAST(doc_id AS BIGINT) AS record_id, text AS seq FROM documents""",
    "nucleotides": """SELECT CAST(doc_id AS BIGINT) AS record_id, translate(regexp_replace(lower(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents""",
    "alignments": f"""SELECT CAST(l_suppkey AS BIGINT) % 20 AS region, CAST(l_orderkey AS BIGINT) AS query_id, CAST(l_partkey AS BIGINT) % 50 AS ref_area, CAST(l_partkey AS BIGINT) AS ref_gene,
        CAST(floor(l_partkey / 50) AS BIGINT) AS ref_idx, l_quantity * 2 AS identity, round(l_tax * 1000, 3) AS coverage, l_extendedprice AS score, CAST({_PLACE} AS BIGINT) * 1000 + CAST(l_suppkey AS BIGINT) AS ord FROM lineitem""",
    # Domains of assembly-line genes: an order's line items; most follow one of three patterns, turned by the order's number.
    "domains": f"""SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS record_id, CAST(l_orderkey AS BIGINT) AS gene_id, CAST(l_linenumber * 100 AS BIGINT) AS "start", CAST(l_linenumber * 100 + 80 AS BIGINT) AS "end",
        CASE WHEN l_partkey % 5 = 0 THEN split_part('{_ANY}', ' ', CAST(l_partkey % 28 + 1 AS INT)) ELSE split_part(CASE l_orderkey % 3 WHEN 0 THEN '{_PATTERNS[0]}' WHEN 1 THEN '{_PATTERNS[1]}' ELSE '{_PATTERNS[2]}' END, ' ', CAST((l_linenumber + l_orderkey) % 7 + 1 AS INT)) END AS profile,
        CASE l_suppkey % 4 WHEN 0 THEN 'Trans-AT-KS' WHEN 1 THEN 'Iterative-KS' END AS subtype, CAST({_PLACE} AS BIGINT) * 1000 + CAST(l_suppkey AS BIGINT) AS ord FROM lineitem""",
    # The genes that carry them: one per order, a few in a region.
    "lines": """SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS record_id, CAST(floor(o_orderkey / 20) AS BIGINT) AS region, CAST(o_orderkey AS BIGINT) AS gene_id, CAST(o_orderkey * 1000 AS BIGINT) AS "start", CASE WHEN floor(o_orderkey / 7) % 3 = 0 THEN -1 ELSE 1 END AS strand FROM orders""",
    # Profiles: one row per combination of flags, with a length and a cutoff.
    "profiles": """SELECT concat(f, s) AS profile, k AS length, CAST(k * 500 AS DOUBLE) AS cutoff FROM (VALUES ('A', 'F', 30), ('A', 'O', 40), ('N', 'F', 50), ('N', 'O', 35), ('R', 'F', 45), ('R', 'O', 25)) t(f, s, k)""",
}
SQL_DUCK = SQL | {
    "moments": SQL["moments"].format(seconds="date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)"),
    "nucleotides": SQL["nucleotides"].format(g=", 'g'"),
}
_SPARK = SQL | {
    "moments": SQL["moments"].format(seconds="timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"),
    "nucleotides": SQL["nucleotides"].format(g=""),
}

_SOURCE = {"genes": "lineitem", "hits": "lineitem", "moments": "events", "sequences": "documents", "nucleotides": "documents", "alignments": "lineitem", "domains": "lineitem", "lines": "orders", "profiles": None}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A canonical table over the Parquet tables in ``folder``, or one of those tables itself."""
    if name not in _SPARK:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    body, source = _SPARK[name].replace('"', "`"), _SOURCE[name]
    if source is None:
        return spark.sql(body)
    columns = body[body.index("SELECT ") + 7 : body.rindex(" FROM ")]
    return spark.read.parquet(f"{folder}/{source}.parquet").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """A select list by its top-level commas."""
    out, depth, at, quoted = [], 0, 0, False
    for k, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c in "([") - (c in ")]") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[at:k])
            at = k + 1
    return [*out, columns[at:]]


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    """An oracle over canonical tables: their definitions, then ``body`` (which may begin with further ones and a comma)."""
    ctes = ",\n".join(f"{n} AS ({SQL_DUCK[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body if body.lstrip().startswith(',') else chr(10) + body}"


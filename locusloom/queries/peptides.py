"""Queries on peptides: every sentence of a text is one, its first letters the leader; surroundings follow from its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import peptides as ops
from ..registry import query
from ..tables import table, with_tables

_NAMES = sorted({x for rules in ops.WEIGHTS.values() for condition, _ in rules for x in condition.split("'")[1::2] if "array_contains(domains" in condition} | {"thio_amide", "PF06968", "DUF4135", "Pkinase", "Lant_dehydr_C", "PF00733"})
_OWN = ["Gallidermin", "TIGR04404", "Subtilosin_A", "TIGR03973", "strep_PEQAXS"]
_KINDS = ["lanthipeptide", "lassopeptide", "thiopeptide"]
_LETTERS = "[^acdefghiklmnpqrstvwxy]"

_SQL = f"""p AS (SELECT record_id, k, p, (length(p) * 2) // 5 AS cut FROM (SELECT record_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS t FROM (SELECT record_id, string_split(seq, '.') AS s FROM sequences)) x, LATERAL (SELECT upper(regexp_replace(lower(x.t), '{_LETTERS}', '', 'g')) AS p) y),
    q AS (SELECT record_id, k, substr(p, 1, CAST(cut AS INT)) AS leader, substr(p, CAST(cut + 1 AS INT)) AS core, p AS precursor, record_id * 31 + k * 17 AS z FROM p),
    peptides AS (SELECT *, list_filter({_NAMES}, lambda n, i: (z + (i - 1) * 7) % 5 < 2) AS domains, list_filter({_OWN}, lambda n, i: (z + (i - 1)) % 9 = 0) AS own, z % 1700 - 1 AS distance, (z * 13) % 24000 - 1 AS distance_protease, z % 2 = 0 AS same_strand, z % 3 > 0 AS starts_atg, CASE WHEN z % 4 > 0 THEN z % 160 END AS domain_start FROM q)"""


def _peptides(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sequences").select("record_id", F.posexplode(F.split("seq", r"\.")).alias("k", "text"))
    rows = rows.select("record_id", (F.col("k") + 1).cast("long").alias("k"), F.upper(F.regexp_replace(F.lower("text"), _LETTERS, "")).alias("p")).withColumn("cut", F.expr("cast(length(p) * 2 div 5 as int)"))
    rows = rows.select("record_id", "k", F.expr("left(p, cut)").alias("leader"), F.expr("substr(p, cut + 1)").alias("core"), (F.col("record_id") * 31 + F.col("k") * 17).alias("z"))
    chosen = lambda names, fits: F.filter(F.array(*map(F.lit, names)), lambda n, i: fits(i))
    return rows.withColumns({
        "domains": chosen(_NAMES, lambda i: (F.col("z") + i * 7) % 5 < 2), "own": chosen(_OWN, lambda i: (F.col("z") + i) % 9 == 0), "distance": F.col("z") % 1700 - 1, "distance_protease": (F.col("z") * 13) % 24000 - 1,
        "same_strand": F.col("z") % 2 == 0, "starts_atg": F.col("z") % 3 > 0, "domain_start": F.when(F.col("z") % 4 > 0, F.col("z") % 160),
    })


def _count_sql(text: str, letters: str) -> str:
    return f"len(list_filter(string_split({text}, ''), lambda x: x <> '' AND contains('{letters}', x)))"


def _mass_sql(text: str, monoisotopic: bool, unknown: float) -> str:
    """Masses letter by letter, from a map of them."""
    masses = "MAP {" + ", ".join(f"'{r}': CAST({m[monoisotopic]} AS DOUBLE)" for r, m in ops.MASSES.items()) + "}"
    return f"(coalesce(list_sum(list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: coalesce({masses}[x], CAST({unknown} AS DOUBLE)))), 0) + CAST({ops.WATER[monoisotopic]} AS DOUBLE))"


def _spans_sql(letters: str, first: str, gaps: range) -> str:
    """Per start the widest gap up to a cysteine, as a list."""
    widest = "CASE " + " ".join(f"WHEN {letters}[i + {g + 1}] = 'C' THEN {g}" for g in reversed(gaps)) + " END"
    return f"list_transform(list_filter(range(1, len({letters}) + 1), lambda i: contains('{first}', {letters}[i]) AND {letters}[i] <> ''), lambda i: {widest})"


def _runs_sql(text: str, letters: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[{letters}]{{2,}}'), lambda r: length(r))"


_PARTS_SQL = ", ".join(f"length({p}) AS len_{p}, {', '.join(f'{_count_sql(p, r)} AS {p}_{r.lower()}' for r in ops.RESIDUES)}, {', '.join(f'{_count_sql(p, v)} AS {p}_{k}' for k, v in ops.GROUPS.items())}, {_mass_sql(p, True, ops.UNKNOWN_MASS)} AS mass_{p}, {_mass_sql(p, True, 0)} AS known_mass_{p}" for p in ops.PARTS)
_at = lambda i: f"pl[{i}]"
_FEATURES_SQL = f"""{_SQL}, f1 AS (SELECT *, string_split(core, '') AS cl, string_split(precursor, '') AS pl, {_PARTS_SQL} FROM peptides),
    f2 AS (SELECT *, {", ".join(f"{p}_k + {p}_r - {p}_d - {p}_e AS {p}_charge, {p}_k + {p}_r + {p}_h - {p}_d - {p}_e AS {p}_charge_h" for p in ops.PARTS)},
        {_spans_sql("cl", "ST", range(2, 7))} AS rings, {_spans_sql("pl", "C", ops.CHAINS)} AS chains, {_spans_sql("cl", "C", ops.CHAINS)} AS core_chains, {_runs_sql("core", "C")} AS cr, {_runs_sql("core", "S")} AS sr, {_runs_sql("core", "T")} AS tr, {_runs_sql("core", "CST")} AS br,
        list_concat(list_transform(list_filter(range(2, length(precursor) + 1), lambda i: {_at("i")} = 'C' AND contains('GA', {_at("i - 1")})), lambda i: CASE WHEN i > 2 AND contains('GA', {_at("i - 2")}) THEN i - 2 ELSE i - 1 END),
            list_filter(range(1, length(precursor)), lambda i: {_at("i")} = 'C' AND contains('GA', {_at("i + 1")}))) AS gac,
        list_reduce(list_prepend({{'i': CAST(0 AS BIGINT), 'go': CAST(1 AS BIGINT), 'cut': CAST(0 AS BIGINT)}}, list_transform(range(1, length(precursor) + 1), lambda i: {{'i': i, 'go': CAST(0 AS BIGINT), 'cut': CAST(0 AS BIGINT)}})),
            lambda a, b: CASE WHEN b.i < a.go OR {_at("b.i")} <> 'C' THEN a {" ".join(f"WHEN pl[b.i + {g + 1}] = 'C' THEN {{'i': b.i, 'go': b.i + {g + 1}, 'cut': b.i + {g}}}" for g in (5, 4, 3, 2))} ELSE a END).cut AS tail_from FROM f1),
    features AS (SELECT *, CASE WHEN len_core > 0 THEN len_leader / len_core END AS leader_to_core, CASE WHEN len_leader > 0 THEN len_core / len_leader END AS core_to_leader, CASE WHEN len_precursor > 0 THEN len_core / len_precursor END AS core_share,
        CASE WHEN core_hydroxyl > 0 THEN core_c / core_hydroxyl ELSE 1.0::DOUBLE END AS cst_ratio, CASE WHEN len_core > 0 THEN (core_c + core_s + core_t) / len_core END AS cst_share, len(list_filter(rings, lambda x: x IS NOT NULL)) AS n_rings,
        {", ".join(f"len(list_filter(rings, lambda x: x = {k - 2})) AS ring_{k}" for k in ops.RINGS)}, CAST(coalesce(list_sum(cr), 0) AS BIGINT) AS c_repeats, CAST(coalesce(list_sum(sr), 0) AS BIGINT) AS s_repeats, CAST(coalesce(list_sum(tr), 0) AS BIGINT) AS t_repeats,
        len(cr) + len(sr) + len(tr) AS block_repeats, len(br) AS blocks, coalesce(CAST(list_avg(br) AS DOUBLE), 0) AS block_length, {", ".join(f"len(list_filter(chains, lambda x: x = {k})) AS chain_{k}" for k in ops.CHAINS)}, len(list_filter(core_chains, lambda x: x IS NOT NULL)) AS n_core_chains,
        len(gac) AS n_gac, CASE WHEN len(gac) > 1 THEN list_sum(list_transform(range(2, len(gac) + 1), lambda i: greatest(1, gac[i] - gac[i - 1]))) / (len(gac) - 1) ELSE 0 END AS gac_distance, CASE WHEN len_precursor > 0 THEN (len_precursor - tail_from) / len_precursor END AS c_tail,
        CASE WHEN contains(precursor, 'C') THEN (strpos(precursor, 'C') - 1) / len_precursor END AS first_c, len(list_filter(range(2, len_core + 1), lambda i: cl[i] = cl[i - 1])) > 0 AS has_double, {_count_sql("substr(core, 1, 9)", "P")} AS first_9_p,
        substr(precursor, CAST(len_precursor - ceil(len_precursor / 4) + 1 AS INT)) AS last_quarter, {_count_sql("substr(precursor, 1, CAST((2 * len_precursor) // 3 AS INT))", "C")} AS c_in_two_thirds FROM f2)"""

_COUNTS = [f"{p}_{x}" for p in ops.PARTS for x in ("charge", "charge_h", *[r.lower() for r in ops.RESIDUES], *ops.GROUPS)]
_WHOLE = ["len_leader", "len_core", "len_precursor", *_COUNTS, "n_rings", *[f"ring_{k}" for k in ops.RINGS], "c_repeats", "s_repeats", "t_repeats", "block_repeats", "blocks", *[f"chain_{k}" for k in ops.CHAINS], "n_core_chains", "n_gac", "first_9_p", "c_in_two_thirds"]
_REAL = ["mass_leader", "mass_core", "mass_precursor", "known_mass_core", "known_mass_precursor", "leader_to_core", "core_to_leader", "core_share", "cst_ratio", "cst_share", "block_length", "gac_distance", "c_tail", "first_c"]


@query("H18_peptide_vector", with_tables(f", {_FEATURES_SQL} SELECT record_id, k, {', '.join(f'CAST({c} AS INT) AS {c}' for c in _WHOLE)}, {', '.join(f'round(CAST({c} AS DOUBLE), {6 if 'mass' in c else 12}) AS {c}' for c in _REAL)}, has_double FROM features", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ops.vector(_peptides(spark, folder)).select("record_id", "k", *[F.col(c).cast("int").alias(c) for c in _WHOLE], *[F.round(F.col(c).cast("double"), 6 if "mass" in c else 12).alias(c) for c in _REAL], "has_double")


def _score_sql(name: str) -> str:
    return " + ".join(f"CASE WHEN {condition.replace('regexp_like', 'regexp_matches')} THEN {weight} ELSE 0 END" for condition, weight in ops.WEIGHTS[name])


@query("H19_class_scores", with_tables(f", {_FEATURES_SQL}, s AS (SELECT record_id, k, {', '.join(f'CAST({_score_sql(c)} AS INT) AS {c}_score' for c in ops.WEIGHTS)} FROM features) SELECT *, {', '.join(f'{c}_score >= {t} AS {c}' for c, t in ops.THRESHOLDS.items())} FROM s", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    scored = ops.class_scores(ops.vector(_peptides(spark, folder)))
    return scored.select("record_id", "k", *[f"{c}_score" for c in ops.WEIGHTS], *ops.WEIGHTS)


_FLAGS = ("aminovinyl", "chlorinated", "oxygenated", "lac")
_has = lambda *names: "(" + " OR ".join(f"list_contains(domains, '{n}')" for n in names) + ")"
_TYPED_SQL = f"""{_SQL}, t1 AS (SELECT *, {_KINDS}[z % 3 + 1] AS kind, {", ".join(f"CAST((z // {3 + i}) % {i + 2} = 0 AS INT) AS {f}" for i, f in enumerate(_FLAGS))}, {_count_sql("core", "C")} AS n_c, {_count_sql("core", "ST")} AS n_st, CASE WHEN length(core) = 17 AND contains('TIV', substr(core, 1, 1)) THEN substr(core, 5) ELSE core END AS u FROM peptides),
    t2 AS (SELECT *, CASE kind WHEN 'lanthipeptide' THEN CASE WHEN {_has("Lant_dehydr_N", "Lant_dehydr_C")} THEN 'Class-I' WHEN {_has("DUF4135")} THEN 'Class-II' WHEN {_has("Pkinase")} THEN 'Class-III' END
        WHEN 'lassopeptide' THEN CASE WHEN n_c >= 4 THEN 'Class I' WHEN n_c >= 2 THEN 'Class III' ELSE 'Class II' END ELSE CASE WHEN {_has("PF06968")} THEN 'Type I' WHEN {_has("PF04055", "PF00733")} THEN 'Type II' ELSE 'Type III' END END AS type,
        CAST(CASE kind WHEN 'lanthipeptide' THEN least(n_c, n_st) - aminovinyl WHEN 'lassopeptide' THEN CASE WHEN n_c >= 4 THEN 2 WHEN n_c >= 2 THEN 1 ELSE 0 END END AS INT) AS bridges,
        CASE WHEN kind = 'lassopeptide' THEN list_last(list_transform(list_filter([7, 8, 9], lambda i: substr(core, i, 1) IN ('E', 'D')), lambda i: substr(core, 1, i)))
            WHEN kind = 'thiopeptide' AND u[1] = 'S' THEN CASE WHEN contains(substr(u, CAST(length(u) // 2 + 1 AS INT)), 'SSSSSS') AND u[13] = 'S' THEN '35-member' WHEN contains(substr(u, 10, 3), 'SC') THEN CASE WHEN u[11] = 'S' THEN '29-member' WHEN u[10] = 'S' THEN '26-member' END END END AS ring,
        CASE WHEN kind = 'thiopeptide' THEN CAST(list_contains(domains, 'thio_amide') AS INT) END AS amidation FROM t1)"""


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _peptides(spark, folder).withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("z") % 3 + 1).cast("int")))
    return ops.peptide_types(rows.withColumns({f: F.expr(f"cast((z div {3 + i}) % {i + 2} = 0 as int)") for i, f in enumerate(_FLAGS)}))


@query("H21_peptide_types", with_tables(f", {_TYPED_SQL} SELECT record_id, k, kind, type, bridges, ring, amidation, CASE WHEN kind = 'thiopeptide' THEN CASE type {' '.join(f'''WHEN '{t}' THEN '{m}' ''' for t, m in ops.MATURE.items())} END END AS mature FROM t2", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder).select("record_id", "k", "kind", "type", "bridges", "ring", "amidation", "mature")


def _corrected_sql(k: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{name}' THEN {text[k]}" for name, text in ops.CORRECTIONS.items()) + " END"


@query("H20_class_masses", with_tables(f""", {_TYPED_SQL}, t3 AS (SELECT * REPLACE (coalesce(bridges, 0) AS bridges, coalesce(amidation, 0) AS amidation) FROM t2),
    t4 AS (SELECT record_id, k, kind, {_mass_sql("core", False, 0)} + CAST({_corrected_sql(0)} AS DOUBLE) AS weight, {_mass_sql("core", True, 0)} + CAST({_corrected_sql(1)} AS DOUBLE) AS mono_mass, CAST(CASE kind WHEN 'lanthipeptide' THEN greatest(0, n_st - n_c) WHEN 'lassopeptide' THEN 0 ELSE n_st END AS INT) AS n_other FROM t3)
    SELECT record_id, k, kind, round(weight, 4) AS weight, round(mono_mass, 6) AS mono_mass, n_other, CASE WHEN n_other > 0 THEN round(weight + 18.02::DOUBLE * n_other, 4) END AS heaviest FROM t4""", "sequences"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = ops.mature_masses(_typed(spark, folder))
    return rows.select("record_id", "k", "kind", F.round("weight", 4).alias("weight"), F.round("mono_mass", 6).alias("mono_mass"), F.size("other_weights").alias("n_other"), F.round(F.when(F.size("other_weights") > 0, F.array_max("other_weights")), 4).alias("heaviest"))

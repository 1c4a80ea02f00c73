"""Ribosomal peptides: features of leader and core, class scores from a table of weights, masses after maturation, and types.

A peptide is a row with ``leader`` and ``core``. ``vector`` adds its features: letters, rings (overlapping, the longest from each start), runs and the
spacing of cysteines are counted over all letters of an Arrow batch at once; groups, charges, masses and ratios follow from those counts. ``class_scores`` turns
``WEIGHTS`` into one sum of conditions per class over those features and what is known of the peptide's surroundings:
``domains`` (profiles of the area) and ``own`` (of the gene), ``distance`` to the closest biosynthetic gene and ``distance_protease`` (-1: none),
``same_strand``, ``starts_atg``, and ``domain_start`` of the radical enzyme's domain.

Defined results: a null leader or core is empty; ratios over an empty part are null, and a condition on null does not hold; letters that are
no residue count in lengths only, and 110 each in masses.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Residues in the order of the vectors, groups of them, and their masses (average, monoisotopic) without water.
RESIDUES = "ARDNCQEGHILKMFPSTWYV"
GROUPS = {"aromatic": "FWY", "negative": "DE", "positive": "RK", "charged": "RKDE", "aliphatic": "GAVLMI", "hydroxyl": "ST"}
MASSES = {
    "A": (71.0788, 71.037114), "R": (156.1875, 156.101111), "D": (115.0886, 115.026943), "N": (114.1038, 114.042927), "C": (103.1388, 103.009185),
    "Q": (128.1307, 128.058578), "E": (129.1155, 129.042593), "G": (57.0519, 57.021464), "H": (137.1411, 137.058912), "I": (113.1594, 113.084064),
    "L": (113.1594, 113.084064), "K": (128.1741, 128.094963), "M": (131.1926, 131.040485), "F": (147.1766, 147.068414), "P": (97.1167, 97.052764),
    "S": (87.0782, 87.032028), "T": (101.1051, 101.047679), "W": (186.2132, 186.079313), "Y": (163.1760, 163.063329), "V": (99.1326, 99.068414),
}
WATER = (18.015, 18.010565)
UNKNOWN_MASS = 110.0

#: Residues from the first to the last of a ring, and residues between two cysteines.
RINGS, CHAINS = range(4, 9), range(1, 7)

PARTS = ("leader", "core", "precursor")


def _any(column: str, *names: str) -> str:
    return "(" + " OR ".join(f"array_contains({column}, '{name}')" for name in names) + ")"


#: What a peptide has to score to belong to a class.
THRESHOLDS = {"lanthipeptide": 14, "lassopeptide": 15, "thiopeptide": 20, "sactipeptide": 26}

#: Per class the conditions, as SQL over the features, and their weights.
WEIGHTS: dict[str, tuple[tuple[str, int], ...]] = {
    "lanthipeptide": (
        ("regexp_like(leader, 'F.LD')", 2),
        ("distance >= 0 AND distance < 500", 1),
        (_any("domains", "Lant_dehyd_C"), 2),
        (_any("domains", "LANC_like"), 2),
        (f"NOT {_any('domains', 'Lant_dehyd_C')}", -2),
        (f"NOT {_any('domains', 'LANC_like')}", -2),
        (_any("domains", "PF14028"), 2),
        (_any("domains", "Peptidase_S8"), 1),
        (_any("domains", "Peptidase_C39"), 1),
        (_any("domains", "PF00005"), 1),
        (_any("domains", "YcaO"), -4),
        (_any("domains", "ThiF"), -4),
        ("known_mass_precursor < 4000", -3),
        ("known_mass_core < 2000", -3),
        (_any("own", "TIGR03731", "Gallidermin", "TIGR04451", "strep_PEQAXS", "LD_lanti_pre", "Antimicr18", "mature_a", "mature_ab", "mature_b"), 3),
        ("len_core >= 35", 1),
        ("contains(left(core, greatest(len_core - 3, 0)), 'CC')", -3),
        ("leader_negative > 4", 1),
        ("leader_charge < 0", 1),
        ("contains(right(core, 3), 'CC')", 2),
        ("regexp_like(core, 'DGCG.TC')", 2),
        ("contains(core, 'SFNS')", 2),
        ("regexp_like(core, 'S..LC')", 2),
        ("regexp_like(core, 'CT.GC')", 1),
        ("contains(core, 'TPGC')", 1),
        ("regexp_like(core, 'SFNS.C')", 1),
        ("core_c < 2", -6),
        ("core_c = 2", -3),
        ("core_c = 0", -10),
        ("core_s = 0", -4),
        ("core_t = 0", -4),
        ("n_rings > 4", 2),
        ("n_rings < 3", -2),
        ("ring_4 > 2", 2),
        ("ring_5 > 2", 2),
        ("ring_6 > 0", 2),
        ("ring_7 > 0", 2),
        ("ring_8 > 0", 1),
    ),
    "lassopeptide": (
        ("distance >= 0 AND distance < 500", 1),
        ("distance >= 0 AND distance < 150", 1),
        ("distance > 1000 OR distance = -1", -2),
        ("core_c IN (2, 4)", 1),
        ("len_leader > len_core", 2),
        ("contains(substr(core, 7, 2), 'E') OR contains(substr(core, 8, 2), 'D')", 1),
        ("regexp_like(leader, 'G.....T')", 3),
        ("left(core, 1) = 'G'", 2),
        ("same_strand", 1),
        ("leader_to_core BETWEEN 0.5 AND 2", 1),
        ("core_g = 0", -4),
        ("core_aromatic >= 1", 1),
        ("core_aromatic >= 2", 2),
        ("core_c % 2 = 1", -2),
        ("leader_w > 0", -1),
        ("leader_k > 0", 1),
        ("leader_c > 0", -2),
        ("distance_protease > 10000 OR distance_protease = -1", -2),
        ("NOT starts_atg", -1),
    ),
    "thiopeptide": (
        (_any("domains", "YcaO"), 2),
        (_any("domains", "Lant_dehyd_N", "PF04738", "tsrC"), 2),
        (_any("domains", "Lant_dehyd_C"), 2),
        (_any("domains", "PF00881"), 2),
        (_any("domains", "PF04055"), 2),
        (_any("domains", "p450"), 1),
        (_any("domains", "PF00005"), 1),
        (_any("domains", "PF01061"), 1),
        (_any("domains", "PF12698"), 1),
        (_any("domains", "PF12697"), 1),
        (_any("domains", "PF00561"), 1),
        ("contains(core, 'CSS')", 1),
        ("contains(core, 'CTT')", 1),
        ("contains(core, 'SS')", 1),
        ("contains(core, 'SSS')", 1),
        ("contains(core, 'SSSS')", 2),
        ("contains(core, 'CC')", 1),
        ("contains(core, 'CCC')", 1),
        ("contains(core, 'CCCC')", 2),
        ("contains(core, 'TT')", 1),
        ("contains(core, 'TTT')", 1),
        ("contains(core, 'TTTT')", 2),
        ("core_c = 0", -2),
        ("core_s = 0", -2),
        ("core_t = 0", -2),
        ("known_mass_core < 2100", 1),
        ("c_repeats + s_repeats + t_repeats > 4", 2),
        ("block_length > 3", 2),
        ("leader_charge < 5", 2),
        ("leader_charge > 0", -2),
        ("leader_c > 0", -1),
        ("right(core, 1) IN ('C', 'S', 'T')", 1),
        ("core_positive >= 2", -1),
        ("cst_share >= 0.4", 2),
    ),
    "sactipeptide": (
        ("distance >= 0 AND distance < 500", 1),
        ("distance >= 0 AND distance < 150", 1),
        ("distance = -1 OR distance > 10000", -2),
        ("first_c BETWEEN 0.25 AND 0.60", 2),
        ("NOT coalesce(first_c BETWEEN 0.25 AND 0.60, false)", -2),
        ("precursor_c >= 3", 4),
        ("precursor_c < 3", -4),
        ("regexp_like(core, 'C.{5}C')", 2),
        ("regexp_like(core, 'C.{3}C')", 1),
        ("regexp_like(core, 'C.{2}C')", 1),
        ("regexp_like(core, 'C.C')", 1),
        ("contains(core, 'CC')", -2),
        ("contains(core, 'CCC')", -2),
        ("NOT contains(last_quarter, 'C')", 1),
        ("contains(last_quarter, 'C')", -1),
        ("c_in_two_thirds = 2 AND precursor_c = 3", 1),
        (_any("own", "Subtilosin_A"), 3),
        (_any("own", "TIGR04404"), 3),
        (_any("own", "TIGR03973"), 2),
        (_any("domains", "PF05402"), 1),
        (_any("domains", "SPASM"), 1),
        ("domain_start > 80", 1),
        (_any("domains", "Peptidase_M16_C"), 1),
        (_any("domains", "Peptidase_S8"), 1),
        (_any("domains", "Peptidase_M16"), 1),
        (_any("domains", "Peptidase_S41"), 1),
        (_any("domains", "PF00005"), 1),
        (_any("domains", "PF00664"), 1),
        (_any("domains", "PF00072"), 1),
        (_any("domains", "PF07690"), 1),
        (_any("domains", "PF13304"), 1),
        (_any("domains", "PF13353"), 1),
        (_any("domains", "PF04055", "TIGR03975"), 2),
        (f"NOT {_any('domains', 'Peptidase_M16_C', 'Peptidase_S8', 'Peptidase_M16', 'Peptidase_S41')}", -2),
        # The share of the part behind the last pair of cysteines is measured from the end and so never in its range.
        ("len_precursor > 0", -2),
        ("n_core_chains > 1", 2),
    ),
}

#: What maturation adds to a core's mass, as SQL over ``n_st`` and ``n_c`` (serine with threonine, cysteine), ``bridges``, ``type`` and the flags.
CORRECTIONS = {
    "lanthipeptide": ("-18.02 * n_st - 46 * aminovinyl + 34 * chlorinated + 16 * oxygenated + 2 * lac", "-18 * n_st - 46 * aminovinyl + 34 * chlorinated + 16 * oxygenated + 2 * lac"),
    "lassopeptide": ("2 * bridges - 18.02", "2 * bridges - 18.02"),
    "thiopeptide": ("CASE WHEN type = 'Type III' THEN 0 ELSE -18.02 * (n_st - 1) - 20 * (n_c - 1) - 35 + CASE WHEN type = 'Type I' THEN 169 ELSE 215 END + 32 END - 70 * amidation",) * 2,
}
#: How many residues may be left as they were, each 18.02 heavier.
UNMODIFIED = {"lanthipeptide": "n_st - n_c", "lassopeptide": "0", "thiopeptide": "n_st"}

#: The first type whose profiles an area has, per class; no type at all for null.
TYPES = {
    "lanthipeptide": ((("Lant_dehydr_N", "Lant_dehydr_C"), "Class-I"), (("DUF4135",), "Class-II"), (("Pkinase",), "Class-III"), ((), None)),
    "thiopeptide": ((("PF06968",), "Type I"), (("PF04055", "PF00733"), "Type II"), ((), "Type III")),
}
MATURE = {"Type I": "Central ring: pyridine tetrasubstituted (hydroxyl group present); second macrocycle", "Type II": "Central ring: piperidine; second macrocycle containing a quinaldic acid moiety", "Type III": "Central ring: pyridine trisubstituted"}


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def mass(text: Column, monoisotopic: bool = True, unknown: float = UNKNOWN_MASS) -> Column:
    """Residues and one water; letters that are no residue weigh ``unknown``."""
    known = reduce(lambda a, b: a + b, [_count(text, r) * masses[monoisotopic] for r, masses in MASSES.items()])
    return known + F.length(F.translate(text, RESIDUES, "")) * F.lit(unknown) + F.lit(WATER[monoisotopic])


#: What is counted per peptide: residues of both parts, rings, chains, runs, and the places of cysteines beside G and A.
COUNTED = (
    *[f"{p}_{r.lower()}" for p in PARTS[:2] for r in RESIDUES], *[f"ring_{k}" for k in RINGS], *[f"chain_{k}" for k in CHAINS], "n_core_chains", *[f"{r}_repeats" for r in "cst"], "block_repeats", "in_blocks", "blocks", "n_gac", "way",
)

#: Letters that are counted at once, and empty places behind each peptide, at least the longest way that is looked ahead.
_AT_ONCE, _APART = 1 << 20, max(*RINGS, *[k + 2 for k in CHAINS])

_PLACE = np.full(128, len(RESIDUES), np.int64)
_PLACE[[ord(r) for r in RESIDUES]] = np.arange(len(RESIDUES))


def _spans(starts: np.ndarray, ends: np.ndarray, gaps: range, row: np.ndarray, n: int) -> list[np.ndarray]:
    """From every start the longest way to an end over so many letters: per number of letters and row, how many."""
    found = {}
    for g in reversed(gaps):
        meets = ends[starts + g + 1]
        found[g], starts = np.bincount(row[starts[meets]], minlength=n), starts[~meets]
    return [found[g] for g in gaps]


def _counted(leader: pa.Array, core: pa.Array) -> list[np.ndarray]:
    """``COUNTED`` for a few peptides: their letters lie in one array, with empty places between them."""
    n, first = len(core), pc.utf8_length(leader).to_numpy(zero_copy_only=False)
    sizes = first + pc.utf8_length(core).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(t for pair in zip(leader.to_pylist(), core.to_pylist(), strict=True) for t in pair).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(n), sizes)
    at = np.arange(len(points)) + _APART * (of + 1)
    letters = np.zeros(len(points) + _APART * (n + 1), np.uint8)
    letters[at] = np.where(points < 128, points, 0)
    row, in_core = np.zeros(len(letters), np.int64), np.zeros(len(letters), bool)
    row[at] = of
    in_core[at] = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= first[of]
    per_row = lambda places: np.bincount(row[places], minlength=n)
    is_a = {c: letters == ord(c) for c in "CSTGA"}
    cysteine = is_a["C"]

    width = len(RESIDUES) + 1
    residues = np.bincount((of * 2 + in_core[at]) * width + _PLACE[letters[at]], minlength=n * 2 * width).reshape(n, 2, width)
    out = [residues[:, part, k] for part in range(2) for k in range(len(RESIDUES))]
    out += _spans(np.flatnonzero((is_a["S"] | is_a["T"]) & in_core), cysteine, range(RINGS[0] - 2, RINGS[-1] - 1), row, n)
    out += _spans(np.flatnonzero(cysteine), cysteine, CHAINS, row, n)
    out.append(sum(_spans(np.flatnonzero(cysteine & in_core), cysteine, CHAINS, row, n)))

    def runs(of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters in runs of at least two of a class within the core, and the number of such runs."""
        inside = of_class & in_core
        before, after = np.roll(inside, 1), np.roll(inside, -1)
        return per_row(np.flatnonzero(inside & (before | after))), per_row(np.flatnonzero(inside & ~before & after))

    single = [runs(is_a[r]) for r in "CST"]
    in_blocks, blocks = runs(cysteine | is_a["S"] | is_a["T"])
    out += [*[letters_in for letters_in, _ in single], sum(number for _, number in single), in_blocks, blocks]

    # Starts of a cysteine after, and of one before, one or two of G and A; both rise along a peptide, so the way between neighbours adds up.
    small = is_a["G"] | is_a["A"]
    after = np.flatnonzero(cysteine & np.roll(small, 1))
    before = np.flatnonzero(cysteine & np.roll(small, -1))

    def ends(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = (np.searchsorted(row[places], np.arange(n), side) for side in ("left", "right"))
        starts = np.append(starts, 0)
        return high - low, starts[np.minimum(low, len(places))], starts[np.maximum(high - 1, 0)]

    n_1, first_1, last_1 = ends(after, after - 1 - small[after - 2])
    n_2, first_2, last_2 = ends(before, before)
    way = np.where(n_1 > 0, last_1 - first_1, 0) + np.where(n_2 > 0, last_2 - first_2, 0) + np.where((n_1 > 0) & (n_2 > 0), np.maximum(1, first_2 - last_1), 0)
    return [*out, n_1 + n_2, way]


def _count_all(leader: pa.Array, core: pa.Array) -> pa.Array:
    """``COUNTED`` as structs, over so many peptides at once that their letters stay few."""
    bound = np.cumsum(pc.binary_length(leader).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(core).to_numpy(zero_copy_only=False) + _APART) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), len(core)] if len(core) else [0, 0]
    done = [_counted(leader[a:b], core[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(some).astype(np.int32)) for some in zip(*done, strict=True)], list(COUNTED))


_letters = F.arrow_udf(_count_all, T.StructType([T.StructField(name, T.IntegerType()) for name in COUNTED])).asNondeterministic()


def vector(peptides: DataFrame) -> DataFrame:
    """``peptides`` (``leader``, ``core``) with the feature columns. Counts of a part are ``{part}_{residue or group}``; ``..._charge`` counts K and R, ``..._charge_h`` also H."""
    rows = peptides.withColumns({"leader": F.coalesce("leader", F.lit("")), "core": F.coalesce("core", F.lit(""))}).withColumn("precursor", F.concat("leader", "core"))
    rows = rows.withColumns({"_n": _letters("leader", "core"), **{f"len_{part}": F.length(part) for part in PARTS}})
    total = lambda some: reduce(lambda a, b: a + b, some)
    out: dict[str, Column] = {}
    for part in PARTS:
        count = {r: total([F.col("_n")[f"{p}_{r.lower()}"] for p in (PARTS[:2] if part == "precursor" else (part,))]) for r in RESIDUES}
        out |= {f"{part}_{r.lower()}": c for r, c in count.items()}
    rows = rows.withColumns(out)
    out = {}
    for part in PARTS:
        count = {r: F.col(f"{part}_{r.lower()}") for r in RESIDUES}
        among = lambda letters, count=count: total([count[r] for r in letters])
        out |= {f"{part}_{name}": among(letters) for name, letters in GROUPS.items()}
        out[f"{part}_charge"], out[f"{part}_charge_h"] = among("KR") - among("DE"), among("KRH") - among("DE")
        known, others = total([count[r] * masses[True] for r, masses in MASSES.items()]), F.col(f"len_{part}") - among(RESIDUES)
        out[f"mass_{part}"], out[f"known_mass_{part}"] = known + others * F.lit(UNKNOWN_MASS) + F.lit(WATER[True]), known + F.lit(WATER[True])
    rows = rows.withColumns(out)
    core, precursor, size = F.col("core"), F.col("precursor"), F.col("len_precursor")
    over = lambda a, b: F.when(b > 0, a / b)
    found = lambda name: F.col("_n")[name]
    tail = F.substring_index(F.regexp_replace(precursor, "(?s)C.{2,5}(?=C)", "|"), "|", -1)
    derived = {
        "leader_to_core": over(F.col("len_leader"), F.col("len_core")),
        "core_to_leader": over(F.col("len_core"), F.col("len_leader")),
        "core_share": over(F.col("len_core"), size),
        "cst_ratio": F.when(F.col("core_hydroxyl") > 0, F.col("core_c") / F.col("core_hydroxyl")).otherwise(1.0),
        "cst_share": over(F.col("core_c") + F.col("core_s") + F.col("core_t"), F.col("len_core")),
        "n_rings": total([found(f"ring_{k}") for k in RINGS]),
        **{name: found(name) for name in COUNTED[COUNTED.index(f"ring_{RINGS[0]}") :] if name not in ("in_blocks", "way")},
        "block_length": F.when(found("blocks") > 0, found("in_blocks") / found("blocks")).otherwise(0.0),
        "gac_distance": F.when(found("n_gac") > 1, found("way") / (found("n_gac") - 1)).otherwise(0.0),
        "c_tail": over(F.length(tail), size),
        "first_c": F.when(F.instr(precursor, "C") > 0, (F.instr(precursor, "C") - 1) / size),
        "has_double": core.rlike(r"(?s)(.)\1"),
        "first_9_p": _count(F.substring(core, 1, 9), "P"),
        "last_quarter": F.right(precursor, F.ceil(size / 4).cast("int")),
        "c_in_two_thirds": _count(F.left(precursor, F.floor(2 * size / 3).cast("int")), "C"),
    }
    return rows.withColumns(derived).drop("_n")


def class_scores(features: DataFrame, weights: dict[str, tuple[tuple[str, int], ...]] = WEIGHTS, thresholds: dict[str, int] = THRESHOLDS) -> DataFrame:
    """``features`` with ``{class}_score`` and ``{class}`` (whether the score reaches the class's threshold): one sum of conditions per class.

    The weights of a class are summed from an array: as one expression they make a method that is too long for the JVM to compile.
    """
    scores = {f"{name}_score": F.aggregate(F.array(*[F.when(F.expr(condition), weight).otherwise(0) for condition, weight in rules]), F.lit(0), lambda total, x: total + x) for name, rules in weights.items()}
    return features.withColumns(scores).withColumns({name: F.col(f"{name}_score") >= thresholds[name] for name in weights})


def _type(name: str, domains: Column) -> Column:
    out = F.lit(None).cast("string")
    for needed, label in reversed(TYPES[name]):
        out = F.when(F.arrays_overlap(domains, F.array(*map(F.lit, needed))), label).otherwise(out) if needed else F.lit(label).cast("string")
    return out


def peptide_types(peptides: DataFrame) -> DataFrame:
    """Rows (``kind``: the class, ``core``, ``domains``, ``aminovinyl``) with their ``type``, ``bridges``, ``ring``, ``amidation`` and ``mature`` text.

    Lanthionine bridges pair cysteines with serines and threonines; a lasso's disulphides follow its cysteines and give its type; its ring reaches to the last
    acidic residue among the seventh to ninth. A thiopeptide's ring follows from where its serines stand.
    """
    core, kind, domains = F.coalesce("core", F.lit("")), F.col("kind"), F.coalesce("domains", F.array().cast("array<string>"))
    n_c, n_st = _count(core, "C"), _count(core, "ST")
    disulphides = F.when(n_c >= 4, 2).when(n_c >= 2, 1).otherwise(0)
    bridges = F.when(kind == "lanthipeptide", F.least(n_c, n_st) - F.coalesce(F.col("aminovinyl"), F.lit(0))).when(kind == "lassopeptide", disulphides)
    lasso = F.when(disulphides == 1, "Class III").when(disulphides == 2, "Class I").otherwise("Class II")
    label = F.when(kind == "lanthipeptide", _type("lanthipeptide", domains)).when(kind == "lassopeptide", lasso).when(kind == "thiopeptide", _type("thiopeptide", domains))
    acid = F.length(F.regexp_extract(F.substring(core, 7, 3), "^(.*[ED])", 1))
    used = F.when((F.length(core) == 17) & core.rlike("^[TIV]"), F.expr("substr(core, 5)")).otherwise(core)
    at = lambda k: F.substring(used, k + 1, 1) == "S"
    late = F.substr(used, (F.floor(F.length(used) / 2) + 1).cast("int"), F.length(used)).contains("SSSSSS") & at(12)
    paired = F.substring(used, 10, 3).contains("SC")
    cycle = F.when(at(0), F.when(late, "35-member").when(paired & at(10), "29-member").when(paired & at(9), "26-member"))
    ring = F.when((kind == "lassopeptide") & (acid > 0), F.left(core, acid + 6)).when(kind == "thiopeptide", cycle)
    rows = peptides.withColumns({"type": label, "bridges": bridges, "ring": ring, "amidation": F.when(kind == "thiopeptide", F.array_contains(domains, "thio_amide").cast("int"))})
    mature = F.lit(None).cast("string")
    for name, text in MATURE.items():
        mature = F.when((kind == "thiopeptide") & (F.col("type") == name), text).otherwise(mature)
    return rows.withColumn("mature", mature)


def mature_masses(typed: DataFrame) -> DataFrame:
    """Rows of ``peptide_types`` (with the flags ``aminovinyl, chlorinated, oxygenated, lac``) with ``weight`` and ``mono_mass`` after maturation, and ``other_weights`` where residues stay unmodified."""
    flags = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("aminovinyl", "chlorinated", "oxygenated", "lac", "amidation", "bridges")}
    core = F.coalesce("core", F.lit(""))
    rows = typed.withColumns(flags | {"n_st": _count(core, "ST"), "n_c": _count(core, "C")})
    pick = lambda table, k: reduce(lambda out, name: F.when(F.col("kind") == name, F.expr(table[name][k] if k is not None else table[name])).otherwise(out), table, F.lit(None))
    weight, mono = mass(core, monoisotopic=False, unknown=0.0) + pick(CORRECTIONS, 0), mass(core, unknown=0.0) + pick(CORRECTIONS, 1)
    rows = rows.withColumns({"weight": weight.cast("double"), "mono_mass": mono.cast("double"), "_left": pick(UNMODIFIED, None).cast("int")})
    others = F.when(F.col("_left") > 0, F.transform(F.sequence(F.lit(1), F.col("_left")), lambda k: F.col("weight") + 18.02 * k)).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("other_weights", others).drop("_left")

"""Scans of sequences: composition, gaps, reading frames, weight matrices, signatures, peptides."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordering import with_adjacent

#: Codons that start and stop a reading frame, and residues by codon (first, second, third base in TCAG order).
STARTS, STOPS = ("ATG", "GTG", "TTG"), ("TAA", "TAG", "TGA")
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: RESIDUES[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}

#: Average residue masses in Da, and water.
MASSES = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594,
    "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
WATER = 18.015


def gc_content(seq: str = "seq") -> Column:
    """The share of G and C."""
    text = F.col(seq)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^GCgc]", "")) / F.length(text)).otherwise(0.0)


def background(seq: str = "seq") -> Column:
    """Probabilities of A, C, G and T from the GC content."""
    gc = gc_content(seq)
    return F.array((1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2)


def intergenic(genes: DataFrame, areas: DataFrame, min_length: int = 0, padding: int = 0) -> DataFrame:
    """``record_id, area_id, start, end`` between an area's genes (``area_id``), opened by ``padding`` into them.

    A gap begins where the genes so far end; the last one runs to the end of the area.
    """
    w = Window.partitionBy("record_id", "area_id").orderBy("start", "end", "gene_id")
    bounded = areas.select("record_id", "area_id", F.col("start").alias("low"), F.col("end").alias("high"))
    reached = genes.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) - padding).join(bounded, ["record_id", "area_id"])
    gaps = reached.select("record_id", "area_id", F.greatest("low", F.coalesce("reach", "low")).alias("start"), F.least("high", F.col("start") + padding).alias("end"))
    last = genes.groupBy("record_id", "area_id").agg((F.max("end") - padding).alias("reach"))
    tails = bounded.join(last, ["record_id", "area_id"], "left").select("record_id", "area_id", F.greatest("low", F.coalesce("reach", "low")).alias("start"), F.col("high").alias("end"))
    return gaps.unionByName(tails).where(F.col("end") - F.col("start") >= max(1, min_length))


def intergenic_of(genes: DataFrame, min_length: int = 0, padding: int = 0) -> DataFrame:
    """As ``intergenic`` with regions as areas, from ``areas.record_regions``: the rows stay as they are dealt, and only gaps leave them."""
    region = Window.partitionBy("record_id", "region").orderBy("start", "end", "gene_id")
    whole = region.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reached = genes.select("record_id", "region", "gene_id", "start", "end", "area_start", "area_end").withColumns({
        "_low": F.min("area_start").over(whole), "_high": F.max("area_end").over(whole),
        "_reach": F.max("end").over(region.rowsBetween(Window.unboundedPreceding, -1)) - padding, "_last": F.lead(F.lit(False), 1, True).over(region),
    })
    before = F.struct(F.greatest("_low", F.coalesce("_reach", "_low")).alias("start"), F.least("_high", F.col("start") + padding).alias("end"))
    behind = F.struct(F.greatest(F.col("_low"), F.col("_reach"), F.col("end") - padding).alias("start"), F.col("_high").alias("end"))
    gaps = reached.select("record_id", F.col("region").alias("area_id"), F.inline(F.array(before, F.when(F.col("_last"), behind))))
    return gaps.where(F.col("end") - F.col("start") >= max(1, min_length))


def reverse_complement(seq: Column) -> Column:
    """The other strand, read backwards."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def codons_of(seq: Column) -> Column:
    """The whole codons of a sequence, in one pass."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))


#: Bases by code; anything else is 4.
_CODE = np.full(256, 4, np.int8)
for _k, _b in enumerate("ACGT"):
    _CODE[[ord(_b), ord(_b.lower())]] = _k


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def _codons(words: Sequence[str]) -> np.ndarray:
    """A mark for each of 125 codon codes that is one of the words."""
    marks = np.zeros(125, bool)
    marks[[int(c[0]) * 25 + int(c[1]) * 5 + int(c[2]) for c in (_codes(w) for w in words)]] = True
    return marks


def _frames(codes: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per frame the starts and ends of reading frames: from the earliest start codon after a stop to the next stop."""
    codon = codes[:-2].astype(np.int16) * 25 + codes[1:-1] * 5 + codes[2:]
    is_start, is_stop = _codons(STARTS)[codon], _codons(STOPS)[codon]
    for frame in range(3):
        starts, stops = np.flatnonzero(is_start[frame::3]), np.flatnonzero(is_stop[frame::3])
        if len(starts) and len(stops):
            before = np.concatenate([[-1], stops[:-1]])
            at = np.searchsorted(starts, before + 1)
            first = starts[np.minimum(at, len(starts) - 1)]
            good = (at < len(starts)) & (first < stops) & ((stops - first) * 3 + 2 >= min_length)
            yield first[good] * 3 + frame, stops[good] * 3 + frame + 3


def scan_orfs(sequences: DataFrame, min_length: int = 60) -> DataFrame:
    """``record_id, strand, start, end``: in six frames, from the earliest start codon to the next stop.

    Sequences are read where they lie, one after another, as arrays of base codes (about 12 bytes a base of the longest one); nothing is shuffled. Null and short sequences have none.
    """
    kind = sequences.schema["record_id"].dataType

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for place, seq in enumerate(batch.column("seq").to_pylist()):
                if seq is not None and len(seq) >= 3:
                    codes = _codes(seq)
                    out += [(place, 1, a, b) for a, b in _frames(codes, min_length)]
                    back = np.where(codes < 4, 3 - codes, 4).astype(np.int8)[::-1]
                    out += [(place, -1, len(codes) - b, len(codes) - a) for a, b in _frames(back, min_length)]
            yield _rows(batch, [o[0] for o in out], [len(o[2]) for o in out], {"strand": [o[1] for o in out]}, {"start": [o[2] for o in out], "end": [o[3] for o in out]})

    schema = T.StructType([T.StructField("record_id", kind), *[T.StructField(n, T.IntegerType()) for n in ("strand", "start", "end")]])
    return sequences.select("record_id", "seq").mapInArrow(scanned, schema)


def _rows(batch: pa.RecordBatch, places: list[int], sizes: list[int], once: Mapping[str, list], each: Mapping[str, list[np.ndarray]]) -> pa.RecordBatch:
    """A batch of found rows: record ids by place, values that hold for a whole block, and arrays of the blocks."""
    columns = {"record_id": batch.column("record_id").take(pa.array(np.repeat(np.array(places, np.int64), sizes)))}
    for name, values in once.items():
        repeated = np.repeat(np.array(values, object if values and isinstance(values[0], str) else np.int32), sizes)
        columns[name] = pa.array(repeated, pa.string() if repeated.dtype == object else pa.int32())
    for name, arrays in each.items():
        whole = np.concatenate(arrays) if arrays else np.zeros(0, np.float64 if name == "score" else np.int64)
        columns[name] = pa.array(whole.astype(np.float64 if name == "score" else np.int32))
    return pa.RecordBatch.from_pydict(columns)


def trim_orf(seq: Column, include: Column, min_length: int, max_length: int) -> Column:
    """Where a reading frame may start latest: the last start codon in frame at or before ``include`` that leaves the length in bounds; null without."""
    starts = F.transform(codons_of(seq), lambda c, k: F.when(c.isin(*STARTS), k * 3))
    bound = F.array(F.struct(F.least(include, F.length(seq) - min_length).alias("high"), (F.length(seq) - max_length).alias("low")))
    latest = F.transform(bound, lambda b: F.array_max(F.filter(starts, lambda k: (k <= b["high"]) & (k >= b["low"]))))
    return F.element_at(latest, 1)


def translate(seq: Column, to_stop: bool = True, new_frame: bool = False) -> Column:
    """Residues of a nucleotide sequence (whole codons; unknown ones X), up to the first stop; read through if nothing stands before it.

    A ``new_frame`` begins with M, whichever codon starts it; an empty one stays empty.
    """
    if new_frame:
        residues = translate(seq, to_stop)
        return F.when(F.length(residues) > 0, F.concat(F.lit("M"), F.substr(residues, F.lit(2), F.length(residues)))).otherwise(residues)
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = codons_of(F.upper(seq))
    residues = F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")
    if not to_stop:
        return residues
    head = F.substring_index(residues, "*", 1)
    return F.when(head == "", F.replace(residues, F.lit("*"), F.lit(""))).otherwise(head)


def codon_positions(genes: DataFrame, codon: str, min_gc: float) -> DataFrame:
    """``record_id, gene_id, position`` of a codon in frame, of genes (``seq``) on records whose ``gc`` reaches the minimum."""
    rich = genes.where(F.col("gc") >= min_gc)
    places = rich.select("record_id", "gene_id", F.posexplode(codons_of(F.upper("seq"))).alias("place", "codon"))
    return places.where(F.col("codon") == codon.upper()).select("record_id", "gene_id", (F.col("place") * 3).alias("position"))


def scan_matrices(sequences: DataFrame, matrices: Mapping[str, Sequence[Mapping[str, float]]], thresholds: Mapping[str, float]) -> DataFrame:
    """``record_id, matrix, start, strand, score``: sums of position weights at every offset of both strands that reach a threshold.

    All matrices are scored in one reading of a sequence, by adding shifted arrays of weights in blocks of a million bases; nothing is shuffled, and only what reaches a
    threshold becomes a row. A character that is no base weighs as the least of its place.
    """
    tables = {}
    for name, weights in matrices.items():
        forward = np.array([[w[b] for b in "ACGT"] + [min(w.values())] for w in weights])
        tables[name] = {1: forward, -1: forward[::-1][:, [3, 2, 1, 0, 4]]}
    block = 1 << 20

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int, np.ndarray, np.ndarray]] = []
            for place, seq in enumerate(batch.column("seq").to_pylist()):
                codes = _codes(seq or "")
                for name, strands in tables.items():
                    for strand, table in strands.items():
                        for low in range(0, len(codes) - len(table) + 1, block):
                            part = codes[low : low + block + len(table) - 1]
                            n = len(part) - len(table) + 1
                            total = np.zeros(n)
                            for k in range(len(table)) if strand == 1 else reversed(range(len(table))):
                                total += table[k][part[k : k + n]]
                            total = np.round(total, 6)
                            at = np.flatnonzero(total >= thresholds[name])
                            if len(at):
                                out.append((place, name, strand, at + low, total[at]))
            yield _rows(batch, [o[0] for o in out], [len(o[3]) for o in out], {"matrix": [o[1] for o in out], "strand": [o[2] for o in out]}, {"start": [o[3] for o in out], "score": [o[4] for o in out]}).select(["record_id", "matrix", "start", "strand", "score"])

    kind = sequences.schema["record_id"].dataType
    schema = T.StructType([T.StructField("record_id", kind), T.StructField("matrix", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("strand", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return sequences.select("record_id", "seq").mapInArrow(scored, schema)


def confidence(score: Column, low: Column, high: Column) -> Column:
    """``weak`` up to the lowest score, ``strong`` from the middle to the highest, else ``medium``."""
    return F.when(score <= low, "weak").when(score >= (low + high) / 2, "strong").otherwise("medium")


def binding_areas(genes: DataFrame, padding: int = 50) -> DataFrame:
    """``record_id, start, end`` where something may bind: gaps between neighbouring genes, opened at their starts; none between two gene ends."""
    paired = with_adjacent(genes, ["record_id"], ["start", "end", "gene_id"], ["end", "strand"]).where("before is not null")
    left, forward = F.col("before.strand"), F.col("strand") == 1
    low = F.when(left == -1, F.col("before.end") - padding).otherwise(F.col("before.end"))
    high = F.when(forward, F.col("start") + padding).otherwise(F.col("start"))
    return paired.where(~((left == 1) & (F.col("strand") == -1))).select("record_id", low.alias("start"), high.alias("end")).where("start < end")


def extract_signature(query: Column, reference: Column, positions: Sequence[int]) -> Column:
    """The query's characters at ungapped positions of the aligned reference; null if one is missing."""
    split = lambda text: F.split(text, "")
    size = F.least(F.length(query), F.length(reference))
    pair = F.array(F.struct(split(query).alias("query"), split(reference).alias("reference")))

    def signature(p: Column) -> Column:
        columns = F.filter(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda k: F.element_at(p["reference"], k) != "-")
        wanted = F.array(*[F.lit(x) for x in positions])
        letters = F.transform(wanted, lambda x: F.element_at(p["query"], F.get(columns, x)))
        return F.when(F.size(columns) > max(positions), F.array_join(letters, ""))

    return F.element_at(F.transform(pair, signature), 1)


def signature_similarity(queries: DataFrame, references: DataFrame, at_least: float = 50.0) -> DataFrame:
    """``query_id, label, similarity``: per query and label the best share (in per cent) of equal places above the bound.

    ``references`` (``label, ref_sig``) is a table of known signatures. Every query is compared with all of its length, so their number multiplies the work; Spark broadcasts them only
    while they are small.
    """
    same = F.aggregate(F.sequence(F.lit(1), F.length("signature")), F.lit(0), lambda n, k: n + (F.substr("signature", k, F.lit(1)) == F.substr("ref_sig", k, F.lit(1))).cast("int"))
    joined = queries.where("length(signature) > 0").join(references, F.length("signature") == F.length("ref_sig"))
    scored = joined.select("query_id", "label", (100.0 * same / F.length("signature")).alias("similarity")).where(F.col("similarity") > at_least)
    return scored.groupBy("query_id", "label").agg(F.max("similarity").alias("similarity"))


def classify_signature(signature: Column, rules: Sequence[tuple[str, Mapping[int, str]]], default: str) -> Column:
    """The first label whose residues (0-based place to allowed letters) all stand in the signature."""
    out = F.lit(default)
    for label, places in reversed(rules):
        fits = F.lit(True)
        for place, letters in places.items():
            fits = fits & F.substring(signature, place + 1, 1).isin(*letters)
        out = F.when(fits, label).otherwise(out)
    return out


def trim_alignment(rows: DataFrame, share: float = 1 / 3) -> DataFrame:
    """``alignment_id, first, last``: the outermost columns whose commonest character is no gap and stands in at least a share of the rows."""
    columns = rows.select("alignment_id", F.posexplode(F.split("aligned", "")).alias("column", "letter")).where("letter <> ''")
    counted = columns.groupBy("alignment_id", "column", "letter").agg(F.count("*").alias("n"))
    best = counted.groupBy("alignment_id", "column").agg(F.max(F.struct("n", "letter")).alias("top"))
    sizes = rows.groupBy("alignment_id").agg(F.count("*").alias("rows"))
    good = best.join(sizes, "alignment_id").where((F.col("top.letter") != "-") & (F.col("top.n") >= F.col("rows") * F.lit(share)))
    return good.groupBy("alignment_id").agg(F.min("column").alias("first"), F.max("column").alias("last"))


def cleavage_site(seq: Column, rules: Sequence[tuple[str, int]], min_tail: int = 1) -> Column:
    """The end of the leader: by the first rule (regex, offset) whose last match leaves a tail long enough; null without."""
    found = []
    for regex, offset in rules:
        head = F.regexp_extract(seq, f"(?s)^(.*(?:{regex}))", 1)
        site = F.length(head) + offset
        found.append(F.when((F.length(head) > 0) & (F.length(seq) - site >= min_tail), site))
    return F.coalesce(*found)


def peptide_features(seq: Column, classes: Mapping[str, str]) -> list[Column]:
    """Counts of each residue class (name to letters), the length, and the number of cysteines that face another one two to five places on."""
    counts = [(F.length(seq) - F.length(F.translate(seq, letters, ""))).alias(f"n_{name}") for name, letters in classes.items()]
    facing = F.coalesce(F.regexp_count(seq, F.lit("(?s)C(?=.{1,4}C)")), F.lit(0))
    return [F.length(seq).alias("length"), *counts, facing.alias("n_facing_cys")]


def heuristic_score(weights: Sequence[tuple[Column, int]]) -> Column:
    """The sum of the weights whose condition holds."""
    total = F.lit(0)
    for condition, weight in weights:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def peptide_mass(seq: Column, monoisotopic_loss: float = 0.0) -> Column:
    """Residue masses and one water, less ``monoisotopic_loss`` (what modifications take away)."""
    total = F.lit(WATER - monoisotopic_loss)
    for residue, mass in MASSES.items():
        total = total + (F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))) * mass
    return total


def alternative_masses(mass: Column, n: Column, step: float = WATER) -> Column:
    """The masses with one to ``n`` residues left unmodified."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: mass + k * step)).otherwise(F.array().cast("array<double>"))


def peptide_class(profiles: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "unknown") -> Column:
    """The first class whose profiles are all among an area's."""
    out = F.lit(default)
    for label, needed in reversed(rules):
        fits = F.lit(True)
        for name in needed:
            fits = fits & F.array_contains(profiles, name)
        out = F.when(fits, label).otherwise(out)
    return out


def approx_pattern(seqs: DataFrame, pattern: str, misses: int = 1, max_start: int = 50) -> DataFrame:
    """``record_id, start, score``: places under ``max_start`` where the pattern (``.``: any) fits with at most so many misses; score is the share of fitting letters."""
    wanted = [(k, c) for k, c in enumerate(pattern) if c != "."]
    last = F.least(F.length("seq") - len(pattern), F.lit(max_start - 1))
    places = seqs.select("record_id", F.substring("seq", 1, max_start + len(pattern)).alias("seq"), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("start"))
    fit = F.lit(0)
    for k, letter in wanted:
        fit = fit + (F.substr("seq", F.col("start") + k + 1, F.lit(1)) == letter).cast("int")
    return places.select("record_id", "start", fit.alias("fit")).where(F.col("fit") >= len(wanted) - misses).select("record_id", "start", (F.col("fit") / len(wanted)).alias("score"))


def regex_detector(seqs: DataFrame, regex: str, min_length: int, max_length: int) -> DataFrame:
    """Sequences within length bounds that match."""
    return seqs.where(F.length("seq").between(min_length, max_length) & F.col("seq").rlike(regex))

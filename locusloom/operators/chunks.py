"""Scans of sequences of any length in chunks with halos, so that a chromosome is many tasks and none holds it as an array.

A sequence is cut into pieces of ``size`` bases that know a few bases of their neighbours; pieces are dealt over tasks. What begins in a piece is
found there. Reading frames that a piece leaves open are closed by one row per piece, strand and frame: the earliest start codon
since the last stop is carried on by a window over a record's pieces, of which there are as many as its length holds ``size``.

Defined results: as the scans of whole sequences give; null and short sequences have no rows; ``record_id`` is unique and not null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import stored
from .scans import STARTS, STOPS, _codes, _codons, scan_matrices

#: Bases of a piece.
SIZE = 1 << 20


def pieces(sequences: DataFrame, size: int = SIZE, before: int = 0, after: int = 0) -> DataFrame:
    """``record_id, offset, own, left, length, seq``: pieces with up to ``before`` and ``after`` bases more, dealt over tasks; ``own`` bases from ``left`` on are the piece's."""
    # Empty ones have no offsets. A filter on the length would be moved below what makes the texts, and make them twice.
    offsets = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size)))
    cut = sequences.select("record_id", "seq", F.length("seq").alias("length"), F.explode(offsets).alias("offset"))
    left = F.least("offset", F.lit(before))
    text = F.substr("seq", F.col("offset") - left + 1, left + size + after)
    return cut.select("record_id", "offset", F.least(F.lit(size), F.col("length") - F.col("offset")).alias("own"), left.alias("left"), "length", text.alias("seq")).repartition("record_id", "offset")


def scan_long_matrices(sequences: DataFrame, matrices: Mapping[str, Sequence[Mapping[str, float]]], thresholds: Mapping[str, float], size: int = SIZE) -> DataFrame:
    """The rows of ``scan_matrices``, found piece by piece with a halo as long as the longest matrix."""
    halo = max(map(len, matrices.values())) - 1
    named = pieces(sequences, size, after=halo).select(F.struct("record_id", "offset", "own").alias("record_id"), "seq")
    found = scan_matrices(named, matrices, thresholds).where(F.col("start") < F.col("record_id.own"))
    return found.select("record_id.record_id", "matrix", (F.col("start") + F.col("record_id.offset")).alias("start"), "strand", "score")


#: Letters of pieces that are scanned at once; a longer piece is scanned alone.
_AT_ONCE = 1 << 20


def _scan(texts: Sequence[str], offset: np.ndarray, own: np.ndarray, left: np.ndarray, length: np.ndarray, strand: int, min_length: int) -> tuple[list[np.ndarray], list[np.ma.MaskedArray]]:
    """One strand of some pieces at once. Frames closed between two stops of a piece: piece, frame, start, stop; edges: piece, frame, place of the piece, first stop, earliest start before it, earliest start after the last.

    Codons are put in order by piece, frame and place; starts that follow the same stop are one run, of which the first counts.
    """
    codes = np.concatenate([_codes("".join(texts)), np.full(2, 4, np.int8)]).astype(np.int16)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    if strand == -1:
        # Read from the right: the codon at a place ends two places before it.
        codes = np.where(codes < 4, 3 - codes, 4)[:-2]
        codon = np.concatenate([np.full(2, 124, np.int16), codes[2:] * 25 + codes[1:-1] * 5 + codes[:-2]])[: len(codes)]
    else:
        codon = codes[:-2] * 25 + codes[1:-1] * 5 + codes[2:]
    at = np.flatnonzero(_codons((*STARTS, *STOPS))[codon])
    piece = np.searchsorted(np.cumsum(sizes), at, "right")
    inner = at - begins[piece]
    good = (inner >= left[piece]) & (inner < left[piece] + own[piece]) & ((inner + 2 < sizes[piece]) if strand == 1 else (inner >= 2))
    at, piece, inner = at[good], piece[good], inner[good]
    place = offset[piece] + inner - left[piece]
    if strand == -1:
        place = length[piece] - 1 - place
    frame = place % 3
    order = np.lexsort((place, piece * 3 + frame))
    key, place, stops = (piece * 3 + frame)[order], place[order], _codons(STOPS)[codon[at]][order]
    before = np.cumsum(stops)[~stops]
    start_key, start = key[~stops], place[~stops]
    new = np.ones(len(start), bool)
    new[1:] = (start_key[1:] != start_key[:-1]) | (before[1:] != before[:-1])
    start_key, start, before = start_key[new], start[new], before[new]
    stop_key, stop = key[stops], place[stops]
    # The earliest start of the run in front of every stop, -1 for none.
    opened = np.full(len(stop), -1, np.int64)
    ahead = np.flatnonzero(before < len(stop))
    ahead = ahead[stop_key[before[ahead]] == start_key[ahead]]
    opened[before[ahead]] = start[ahead]
    inside = np.zeros(len(stop), bool)
    inside[1:] = stop_key[1:] == stop_key[:-1]
    closed = np.flatnonzero(inside & (opened >= 0) & (stop - opened + 2 >= min_length))

    some = np.unique(key)
    low, high = np.searchsorted(stop_key, some, "left"), np.searchsorted(stop_key, some, "right")
    stopped = high > low
    first_run, last_run = np.searchsorted(start_key, some, "left"), np.searchsorted(start_key, some, "right") - 1
    taken = lambda values, places: np.append(values, -1)[np.clip(places, 0, len(values))]
    early = np.where(stopped, taken(opened, low), taken(start, first_run))
    late = np.where((last_run >= first_run) & (taken(before, last_run) == high), taken(start, last_run), -1)
    late = np.where(stopped, late, early)
    edge = some // 3
    first = offset[edge] if strand == 1 else length[edge] - offset[edge] - own[edge]
    known = lambda values: np.ma.masked_less(values, 0)
    return [stop_key[closed] // 3, stop_key[closed] % 3, opened[closed], stop[closed]], [edge, some % 3, first, known(np.where(stopped, taken(stop, low), -1)), known(early), known(late)]


def _nullable(values: np.ndarray | np.ma.MaskedArray | None, n: int) -> pa.Array:
    """Whole numbers, null where masked; nulls alone for none."""
    return pa.nulls(n, pa.int64()) if values is None else pa.array(np.ma.getdata(values), pa.int64(), mask=np.ma.getmaskarray(values))


def scan_long_orfs(sequences: DataFrame, min_length: int = 60, size: int = SIZE) -> DataFrame:
    """The rows of ``scan_orfs``, found piece by piece.

    A piece's row of a strand and frame says where its first stop is, its earliest start before that, and its earliest start after its last stop.
    """
    kind = sequences.schema["record_id"].dataType
    numbers = ("strand", "frame", "piece", "start", "stop", "first", "open")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("seq").to_pylist()
            offset, own, left, length = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("offset", "own", "left", "length"))
            bound = np.cumsum([len(t) for t in texts]) // _AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), len(texts)] if texts else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for strand in (1, -1):
                    (piece, frame, start, stop), (edge, edge_frame, place, first_stop, early, late) = _scan(texts[a:b], offset[a:b], own[a:b], left[a:b], length[a:b], strand, min_length)
                    ids = pa.array(np.concatenate([piece, edge]) + a)
                    joined = lambda x, y: pa.concat_arrays([_nullable(x, len(piece)), _nullable(y, len(edge))])  # noqa: B023, E731
                    values = (np.full(len(ids), strand), np.concatenate([frame, edge_frame]), joined(None, place), joined(start, None), joined(stop, first_stop), joined(None, early), joined(None, late))
                    columns = {"record_id": batch.column("record_id").take(ids), "length": batch.column("length").take(ids)}
                    yield pa.RecordBatch.from_pydict(columns | {n: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for n, v in zip(numbers, values, strict=True)})

    schema = T.StructType([T.StructField("record_id", kind), T.StructField("length", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in numbers]])
    # Stored, as both kinds of rows are read from it and texts are to be scanned once.
    found = stored(pieces(sequences, size, before=2, after=2).mapInArrow(scanned, schema))
    inside = found.where("piece is null").select("record_id", "strand", "length", "start", "stop")
    w = Window.partitionBy("record_id", "strand", "frame").orderBy("piece")
    # Pieces from one with a stop up to the next; the first open start among those before a piece is carried into it.
    edges = found.where("piece is not null").withColumn("group", F.sum(F.col("stop").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.first("open", ignorenulls=True).over(Window.partitionBy("record_id", "strand", "frame", "group").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.withColumn("carry", carried).withColumn("carry", F.lag("carry").over(w))
    closed = edges.where("stop is not null").select("record_id", "strand", "length", F.coalesce("carry", "first").alias("start"), "stop").where(F.col("stop") - F.col("start") + 2 >= min_length)
    every = inside.unionByName(closed)
    forward, end = F.col("strand") == 1, F.col("stop") + 3
    start = F.when(forward, F.col("start")).otherwise(F.col("length") - end)
    return every.select("record_id", F.col("strand").cast("int").alias("strand"), start.cast("int").alias("start"), F.when(forward, end).otherwise(F.col("length") - F.col("start")).cast("int").alias("end"))

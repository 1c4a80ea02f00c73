"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Each text is reduced to a short vector of statistics. Random Fourier features approximate a
Gaussian kernel over the standardised vectors; each partition of the training rows sums its part
of the normal equations, the driver adds those sums and solves the ridge system (its size follows
the number of features, not of rows). A held-back fold of the training rows, counted in score
bins, gives the isotonic curve from raw score to probability.

Defined results: null and empty texts are scored like any other (all statistics 0); labels other
than 0 and 1 and labels of unknown documents are ignored, repeated labels count each; without any
training row every score is 0.5; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import cut
from .quality_rules import measured
from .words import free_name, in_small_batches, slices

FEATURES = 14
#: Score from which a document counts as good.
THRESHOLD = 0.3

_PUNCT, _DIGIT, _HIGH = np.zeros(256, bool), np.zeros(256, bool), np.arange(256) >= 0x80
_PUNCT[list(b".,;:!?'\"()[]{}-_/\\|#*$%&<>=+~^@`")] = True
_DIGIT[ord("0") : ord("9") + 1] = True


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that are fitted (a sample by hash beyond it)."""

    components: int = 256
    bandwidth: float = 3.0
    ridge: float = 1e-2
    seed: int = 7
    train_rows: int = 200_000
    bins: int = 600
    parts: int = 48


def statistics(texts: pa.Array) -> pa.Array:
    """The statistics of each text, as a list of doubles."""
    m = measured(texts)
    at = {name: np.asarray(m.field(name), dtype=float) for name in [f.name for f in m.type]}
    n, words, chars = len(m), np.maximum(at["n_words"], 1), np.maximum(at["word_chars"], 1)
    size, punct, digit, high, unique = (np.zeros(n) for _ in range(5))
    for s in slices(texts):
        here = np.s_[s.first : s.first + s.n]
        size[here] = np.diff(s.text_at)
        punct[here], digit[here], high[here] = s.counts(_PUNCT[s.data]), s.counts(_DIGIT[s.data]), s.counts(_HIGH[s.data])
        hashes = s.word_hashes()
        text = np.repeat(np.arange(s.n, dtype=np.uint64), np.diff(s.word_at))
        key = np.sort((hashes >> np.uint64(24)) | (text << np.uint64(40)))  # sorts by text, so first places count its words
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        unique[here] = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=s.n)
    length = np.maximum(size, 1)
    table = np.stack([
        np.log1p(at["n_words"]), at["word_chars"] / words, np.sqrt(at["n_symbols"] / words), at["n_dup_lines"] / np.maximum(at["n_lines"], 1),
        at["n_repeat_words"] / words, np.log1p(at["n_lines"]), at["n_caps"] / chars, np.sqrt(at["n_exclaim"] / words),
        np.sqrt(at["n_same_as_last"] / words), unique / words, punct / length, digit / length, high / length, np.log1p(at["n_words"] / np.maximum(at["n_lines"], 1)),
    ], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FEATURES, pa.int32()), pa.array(table.ravel()))


_statistics = F.arrow_udf(statistics, T.ArrayType(T.DoubleType())).asNondeterministic()


@dataclass
class Model:
    """Centre and scale of the statistics, the random features, their weights, and the calibration curve."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    settings: Settings
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        s = self.settings
        random = np.random.default_rng(s.seed)
        frequencies = random.normal(size=(FEATURES, s.components)) / s.bandwidth
        phases = random.uniform(0, 2 * np.pi, s.components)
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        return np.concatenate([np.sqrt(2 / s.components) * np.cos(z @ frequencies + phases), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, between 0 and 1."""
        y = self.raw(x)
        if self.curve is not None:
            y = np.interp(y, *self.curve)
        return np.clip(y, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to ``y`` with weights ``n``, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools]) if pools else np.zeros(0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, FEATURES)


def fit(examples: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on rows ``x`` (statistics), ``y`` (0 or 1) and ``calibrate`` (boolean: for the curve only)."""
    n = examples.count()
    if not n:
        return None
    if n > settings.train_rows:
        share = int((1 << 20) * settings.train_rows / n)
        examples = examples.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < share)
    examples = cut(examples.repartition(settings.parts))  # the sample is drawn by as many tasks as the rows have, then dealt
    moments = examples.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(FEATURES) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = np.array([moments[f"m{k}"] for k in range(FEATURES)])
    scale = np.array([moments[f"s{k}"] for k in range(FEATURES)])
    model = Model(centre, np.where(scale > 1e-9, scale, 1.0), np.zeros(settings.components + 1), settings)

    def partial(batches):
        size = settings.components + 1
        normal, rows = np.zeros((size, size + 1)), 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch))
                normal[:, :size] += z.T @ z
                normal[:, size] += z.T @ np.asarray(batch.column("y"), dtype=float)
                rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({"sums": pa.array([normal.tobytes()], pa.binary()), "n": pa.array([rows], pa.int64())})

    def solved(rows: DataFrame) -> bool:
        parts = [r for r in rows.select("x", "y").mapInArrow(partial, "sums binary, n bigint").collect() if r.n]  # one row per partition, at most settings.parts
        if parts:
            total = sum(np.frombuffer(r.sums).reshape(settings.components + 1, -1) for r in parts)
            a, b = total[:, :-1], total[:, -1]
            penalty = settings.ridge * np.eye(len(a))
            penalty[-1, -1] = 1e-9
            model.weights = np.linalg.solve(a + penalty, b)
        return bool(parts)

    if not solved(examples.where(~F.col("calibrate"))):
        solved(examples)

    @F.arrow_udf(T.DoubleType())
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(model.raw(np.asarray(x.flatten()).reshape(-1, FEATURES)))

    step = 3.0 / settings.bins
    counted = examples.where("calibrate").select(F.greatest(F.least(F.floor(raw("x") / step), F.lit(2 * settings.bins)), F.lit(-settings.bins)).alias("bin"), "y").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    bins = sorted(counted.collect())  # bounded: scores beyond the last bins count in them
    if bins:
        x = np.array([(r["bin"] + 0.5) * step for r in bins])
        model.curve = (x, isotonic(x, np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins])))
    return model


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from training, fold 4 calibrates. Null ids are in fold 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def train(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on ``stats`` (``doc_id``, ``x``) with the labels of documents outside fold 0."""
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("double").alias("y"))
    return fit(stats.where(fold() != 0).join(marked, "doc_id").select("x", "y", (fold() == 4).alias("calibrate")), settings)


def scorer(model: Model | None):
    """A function from the statistics column to the score column."""

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        flat = np.asarray(x.flatten()).reshape(-1, FEATURES)
        return pa.array(model.score(flat) if model else np.full(len(flat), 0.5))

    return score


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``.

    The texts are read once: their statistics are stored, then used to fit and to score.
    """
    stats = cut(in_small_batches(docs).select("doc_id", _statistics(F.col("text")).alias("x")))
    scored = stats.select("doc_id", (fold() == 0).alias("held_out"), scorer(train(stats, labels, settings))(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with the columns of ``docs`` and no others.

    The fit reads the labelled texts only; the texts are then scored where they are read, without a shuffle.
    """
    known = labels.where("quality in (0, 1)").select("doc_id").distinct()
    stats = cut(in_small_batches(docs).where(fold() != 0).select("doc_id", "text").join(known, "doc_id", "left_semi").select("doc_id", _statistics(F.col("text")).alias("x")))
    good = scorer(train(stats, labels, settings))(_statistics(F.col("text"))) >= THRESHOLD
    found = free_name(docs, "_good")
    return docs.withColumn(found, good).where(found).select(*[F.col(f"`{c}`") for c in docs.columns])

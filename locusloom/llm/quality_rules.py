"""Quality rules as a ledger: measure once, store failure bits, decide later.

``ledger`` evaluates every rule once per document and stores its measurements and one 64-bit mask
of failed rules. A ``Policy`` is a version and the set of rules that reject; applying one, or
asking what a rule does under it (``ablations``), only needs the stored bits.

Defined results: a null or empty text has no words, so all counts are 0 and ``too_few_words``
fails; repeated rows and repeated or null ids are judged row by row; an empty table gives an empty
ledger; further columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NOT_SPACE, STARTS_CHAR, free_name, in_small_batches, slices

#: Words that a repeated passage has at least.
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_exclaim", "n_same_as_last"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, a SQL condition over the measurements, is true."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document; ``base`` are those that reject by contract."""

    version: str
    rejects: tuple[str, ...]
    base: tuple[str, ...] = ("too_few_words", "repeated_passages")


RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "shouting", "100 * n_caps > 50 * word_chars"),
    Rule(5, "exclamations", "100 * n_exclaim > 50 * n_words"),
    Rule(6, "stuttering", "100 * n_same_as_last > 30 * n_words"),
    Rule(7, "short_words", "n_words > 0 and 10 * word_chars < 20 * n_words"),
    Rule(8, "long_words", "word_chars > 25 * n_words"),
)

#: Policies by version; the last one is in force.
POLICIES = {
    "2024-base": Policy("2024-base", ("too_few_words", "repeated_passages")),
    "2025-full": Policy("2025-full", tuple(r.name for r in RULES)),
}
CURRENT = POLICIES["2025-full"]

_SYMBOL, _CAPS, _EXCLAIM = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPS[ord("A") : ord("Z") + 1] = True
_EXCLAIM[ord("!")] = True
_IN_WORD = STARTS_CHAR & NOT_SPACE  # white space is one byte a character


def _repeated(s, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows that the text holds twice or more."""
    windows, at = s.windows(hashes, WINDOW)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(windows):
        each = np.diff(at)
        text = np.repeat(np.arange(s.n, dtype=np.uint64), each)
        begin = np.repeat(s.word_at[:-1] - at[:-1], each) + np.arange(len(windows))
        key = windows + text * np.uint64(0x9FB21C651E98DF25)  # a window counts inside its own text only
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = begin[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        covered[: len(hashes)] += np.bincount(twice, minlength=len(hashes))
        covered += -np.bincount(twice + WINDOW, minlength=len(hashes) + 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[s.word_at[1:]] - inside[s.word_at[:-1]]


def measured(texts: pa.Array) -> pa.Array:
    """The measurements of each text."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in MEASURES}
    for s in slices(texts):
        hashes = s.word_hashes()
        same = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > 1:
            last = np.zeros(len(hashes), bool)
            last[1:] = hashes[1:] == hashes[:-1]
            last[s.word_at[:-1][s.word_at[:-1] < len(hashes)]] = False
            same[1:] = np.cumsum(last)
        lines, repeats = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
        raw = s.data.tobytes()
        for k in range(s.n):
            full = [x for x in raw[s.text_at[k] : s.text_at[k + 1]].split(b"\n") if x.strip()]
            lines[k], repeats[k] = len(full), len(full) - len(set(full))
        found = {
            "n_words": np.diff(s.word_at),
            "word_chars": s.counts(_IN_WORD[s.data]),
            "n_symbols": s.counts(_SYMBOL[s.data]),
            "n_dup_lines": repeats,
            "n_repeat_words": _repeated(s, hashes),
            "n_lines": lines,
            "n_caps": s.counts(_CAPS[s.data]),
            "n_exclaim": s.counts(_EXCLAIM[s.data]),
            "n_same_as_last": same[s.word_at[1:]] - same[s.word_at[:-1]],
        }
        for name in MEASURES:
            parts[name].append(found[name])
    columns = [pa.array(np.concatenate(parts[name]) if parts[name] else np.zeros(0, np.int64), pa.int64()) for name in MEASURES]
    return pa.StructArray.from_arrays(columns, MEASURES)


# Not deterministic in name only: the optimiser must not evaluate it once per use.
_measure = F.arrow_udf(measured, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])).asNondeterministic()


def _bits(rules: Sequence[Rule], at: str) -> Column:
    """One mask of the failed rules, over measurements in the struct column ``at``."""
    total = F.lit(0).cast("long")
    for rule in rules:
        condition = rule.fails
        for name in MEASURES:
            condition = condition.replace(name, f"{at}.{name}")
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return total


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, every measurement and ``fail_bits`` of each row of ``docs``."""
    rows = in_small_batches(docs).select("doc_id", _measure(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.*", _bits(rules, "m").alias("fail_bits"))


def decided(book: DataFrame, policy: Policy = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and ``policy`` under a policy."""
    bits = F.col("fail_bits")
    base, rejects = mask(policy.base, rules), mask(policy.rejects, rules)
    return book.withColumns({
        "base_failed": bits.bitwiseAND(F.lit(base)) != 0,
        "kept": bits.bitwiseAND(F.lit(base | rejects)) == 0,
        "policy": F.lit(policy.version),
    })


def ablations(book: DataFrame, policy: Policy = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger is first counted by its masked bits (2**rules groups at most, combined before the
    shuffle); all else is bitwise work on those counts.
    """
    active = mask([*policy.base, *policy.rejects], rules)
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(active)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if active >> r.bit & 1])
    pairs = counts.select("bits", "n", F.inline(named))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return pairs.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs`` and no others."""
    rejects = mask([*policy.base, *policy.rejects])
    found = free_name(docs, "_measured")
    marked = in_small_batches(docs).withColumn(found, _measure(F.col("text")))
    return marked.where(_bits(RULES, found).bitwiseAND(F.lit(rejects)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

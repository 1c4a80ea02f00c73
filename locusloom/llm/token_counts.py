"""Token counts of a byte-level BPE vocabulary, without its library.

Texts fall into chunks (white space and what follows it) whose tokens do not depend on their
neighbours. Counts of chunks seen before come from a bounded table in each Python worker. New
chunks are split into pre-tokens, held as one ragged numpy array of symbols, and merged in
synchronised rounds: every sequence applies its lowest-ranked pair at all places at once, until no
sequence has a mergeable pair; the surviving symbols are the tokens. Pre-tokens longer than ``LONG`` bytes share
rounds of their own: as a merge makes pairs of higher ranks only, the places of each rank wait in a queue, and a round looks up
the pairs beside its merges instead of all that are left.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens count
as one token, as the library does by default; rows are counted one by one, whatever their ids; texts and words of any length are counted whole
(about 60 bytes of memory for each byte of a long word); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenizer_files import tokenizer_path
from .words import in_small_batches, slices

#: Unicode white space, and the pre-token pattern that the vocabulary was made with.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Marks that are a pre-token, and as one byte a token, where they end a chunk after letters.
MARKS = frozenset(".,;:!?)")

_NONE = np.int64(1) << 40

#: Bytes beyond which a pre-token is merged by queued ranks.
LONG = 192


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merge rules of a tokenizer file, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocab = stored["model"]["vocab"]
        self.specials = [t["content"] for t in stored["added_tokens"]]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in stored["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        # An open-addressing table, a fifth full for 50,000 pairs, so that most look-ups end at once.
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.ranks, self.made = np.full(slots, -1, np.int64), np.full(slots, _NONE, np.int64), np.zeros(slots, np.int64)
        for rank, (key, slot, (a, b)) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), pairs, strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % slots
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, vocab[a + b]
        self.by_rank = [vocab[a + b] for a, b in pairs]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or an empty slot."""
        slot = self._slot(keys)
        lost = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) % len(self.keys)
            lost = lost[(self.keys[slot[lost]] != keys[lost]) & (self.keys[slot[lost]] >= 0)]
        return slot

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """The number of tokens of each byte sequence."""
        long = [k for k, s in enumerate(sequences) if len(s) > LONG]
        if not long:
            return self._short(sequences)
        out = np.zeros(len(sequences), np.int64)
        out[long] = self._long([sequences[k] for k in long])
        short = np.setdiff1d(np.arange(len(sequences)), long)
        out[short] = self._short([sequences[k] for k in short.tolist()])
        return out

    def _long(self, sequences: list[bytes]) -> np.ndarray:
        """The same for long sequences: a linked list of symbols, and for each rank the places where it waits."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        # A symbol of -1 stands behind each sequence and pairs with nothing.
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.full(int(ends[-1]) + 1, -1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes + 1)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[-1] = len(symbols) - 1
        rank = np.full(len(symbols), _NONE, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look_up(at: np.ndarray) -> None:
            """Rank the pairs that begin at places, and queue them."""
            left, right = symbols[at], symbols[after[at]]
            rank[at] = np.where((left >= 0) & (right >= 0), self.ranks[self._find(np.maximum(left, 0) * self.size + np.maximum(right, 0))], _NONE)
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            found = rank[at]
            begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(at) else []
            for r, places in zip(found[begins].tolist() if len(at) else [], np.split(at, begins[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(places)

        look_up(np.flatnonzero(inside))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # A pair of equal symbols overlaps itself: in a run of places every other one counts, from the left.
            index = np.arange(len(at))
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            at = at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone] = self.by_rank[r], _NONE
            after[at] = after[gone]
            before[after[at]] = at
            sizes -= np.bincount(owner[at], minlength=len(sizes))
            near = before[at]
            look_up(np.unique(np.concatenate([at, near[near >= 0]])))
        return sizes

    def _short(self, sequences: list[bytes]) -> np.ndarray:
        """The same for sequences of any length; each round looks at all symbols that are left."""
        out = np.array([len(s) for s in sequences], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), out)
        while len(symbols) > 1:
            place = self._find(symbols[:-1] * self.size + symbols[1:])
            rank = np.where(owner[:-1] == owner[1:], self.ranks[place], _NONE)
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, _NONE), begins)
            lowest_here = np.repeat(lowest, np.diff(np.append(begins, len(symbols))))
            hit = (rank == lowest_here[:-1]) & (rank < _NONE)
            # A pair of equal symbols overlaps itself: in a run of hits every other one counts, from the left.
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
            hit &= (index - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.made[place[at]]
            np.subtract.at(out, owner[at], 1)
            alive = lowest_here < _NONE
            alive[at + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        return out


class Counter:
    """Counts tokens of texts; remembers at most ``limit`` chunks."""

    def __init__(self, path: str, limit: int = 1 << 20) -> None:
        self.merges, self.limit = Merges(path), limit
        self.chunk = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)) or r"(?!)")
        self.known: dict[str, int] = {}

    def learn(self, chunks: list[str]) -> None:
        """Count new chunks. Most are one run of letters, perhaps after a space and before a mark that is a token of its own."""
        words, marked, others = set(), [], []
        for chunk in chunks:
            word = chunk[:-1] if chunk[-1] in MARKS else chunk
            if not (word[1:] if word[:1] == " " else word).isalpha():
                others.append(chunk)
                continue
            words.add(word)
            if word is not chunk:
                marked.append((chunk, word))
        new = list(words.difference(self.known))
        self.known.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist(), strict=True))
        self.known.update([(chunk, self.known[word] + 1) for chunk, word in marked])
        self.learn_others(others)

    def learn_others(self, chunks: list[str]) -> None:
        """Count new chunks of any form by the pre-token pattern."""
        pieces: list[bytes] = []
        owner: list[int] = []
        fixed = [0] * len(chunks)
        for k, chunk in enumerate(chunks):
            parts = self.special.split(chunk)
            fixed[k] = len(parts) - 1
            for part in parts:
                for x in self.pre_token.findall(part):
                    pieces.append(x.encode())
                    owner.append(k)
        each = np.bincount(owner, weights=self.merges.counts(pieces), minlength=len(chunks)) if pieces else np.zeros(len(chunks))
        self.known.update(zip(chunks, (each.astype(np.int64) + fixed).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self.chunk.findall(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        for k in range(0, len(new), 1 << 15):
            self.learn(new[k : k + (1 << 15)])
        return [sum(map(self.known.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counting(path: str):
    """An Arrow function from texts to their bytes and tokens."""

    def counted(texts: pa.Array) -> pa.Array:
        tool = counter(path)
        sizes, tokens = [np.zeros(0, np.int64)], []
        for s in slices(texts):
            raw, at = s.data.tobytes(), s.text_at
            sizes.append(np.diff(at))
            tokens += tool.count([raw[at[k] : at[k + 1]].decode() for k in range(s.n)])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes), pa.int64()), pa.array(tokens, pa.int64())], ["n_bytes", "n_tokens"])

    return F.arrow_udf(counted, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])).asNondeterministic()


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row of ``docs``; no shuffle."""
    count = counting(path or tokenizer_path("byte_bpe_50k.json"))
    rows = in_small_batches(docs).select("doc_id", count(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))

"""License scans by template markup.

A template is licence wording with two kinds of markup: ``<<beginOptional>>...<<endOptional>>``
may be absent, ``<<var;match=A-B>>`` stands for A to B arbitrary words. Each is compiled into an
automaton over words; a text is accepted where its words pass from the first to the last state, so
all mandatory wording must stand there exactly. Beside the templates, plain phrases are counted.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z.
Defined results: null and empty texts have no words, no places and empty label strings; rows are
scanned one by one whatever their ids; whole texts are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LOWER, in_small_batches, slices

#: The phrases of the base scan and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public licence wording with markup, and the labels. First notices that stand in other texts, then whole licences.
TEMPLATES = (
    ("mit", "<<var;match=1-1>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>"),
    ("gpl-3", "<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3"),
    ("gpl-2", "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v<<beginOptional>>ersion<<endOptional>>. 2.0"),
    ("cc-by-nc", "<<beginOptional>>is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<var;match=1-1>> <<beginOptional>>0<<endOptional>>"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in <<var;match=1-3>> without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of <<var;match=1-3>>, and to permit persons to whom <<var;match=1-3>> is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of <<var;match=1-3>>.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var;match=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;match=1-6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;match=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;match=1-10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL <<var;match=1-10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;match=1-4>> be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
        DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION <<beginOptional>>0.<<endOptional>> You just DO WHAT THE FUCK YOU WANT TO."""),
)

_WORD_BYTES = np.arange(256) >= 0x80
_WORD_BYTES[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[str]:
    """The words of a text as the scan sees them."""
    return [w.decode() for w in _WORD.findall(text.encode().translate(LOWER.tobytes()))]


@dataclass(frozen=True)
class Word:
    """One mandatory word."""

    word: str


@dataclass(frozen=True)
class Any:
    """``least`` to ``most`` arbitrary words."""

    least: int
    most: int


@dataclass(frozen=True)
class Optional:
    """Parts that may be absent together."""

    parts: tuple


def parsed(markup: str) -> tuple:
    """The parts of a template."""
    stack: list[list] = [[]]
    for piece in re.split(r"(<<.*?>>)", markup):
        if piece == "<<beginOptional>>":
            stack.append([])
        elif piece == "<<endOptional>>":
            inner = tuple(stack.pop())
            if inner:
                stack[-1].append(Optional(inner))
        elif found := re.fullmatch(r"<<var;match=(\d+)-(\d+)>>", piece):
            stack[-1].append(Any(int(found[1]), int(found[2])))
        else:
            stack[-1] += [Word(w) for w in words_of(piece)]
    if len(stack) != 1:
        raise ValueError(f"optional parts do not nest: {markup[:60]}")
    return tuple(stack[0])


def mandatory(parts: tuple) -> set[str]:
    """The words that every accepted text holds."""
    return {p.word for p in parts if isinstance(p, Word)}


def pattern(parts: tuple) -> str:
    """The same template as a regular expression over words that each follow a blank (for SQL)."""
    out = ""
    for p in parts:
        if isinstance(p, Word):
            out += " " + p.word
        elif isinstance(p, Any):
            out += "(?: [^ ]+){%d,%d}" % (p.least, p.most)
        else:
            out += "(?:" + pattern(p.parts) + ")?"
    return out


class Automaton:
    """States numbered from 0; ``on`` has the word moves, ``any`` the moves on every word, ``free`` those on none."""

    def __init__(self, parts: tuple) -> None:
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        self.end = self._add(parts, 0)
        self.reach = [self._closed(k) for k in range(len(self.on))]
        self.first = set().union(*(self.on[k] for k in self.reach[0]))
        self.open = any(self.any[k] is not None for k in self.reach[0])

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _add(self, parts: tuple, at: int) -> int:
        for p in parts:
            start = at
            if isinstance(p, Word):
                at = self._state()
                self.on[start][p.word.encode()] = at
            elif isinstance(p, Any):
                ends = [start] if p.least == 0 else []
                for k in range(1, p.most + 1):
                    after = self._state()
                    self.any[at] = after
                    at = after
                    if k >= p.least:
                        ends.append(at)
                for end in ends[:-1]:
                    self.free[end].append(at)
            else:
                inner = self._state()
                self.free[start].append(inner)
                last = self._add(p.parts, inner)
                at = self._state()
                self.free[last].append(at)
                self.free[start].append(at)
        return at

    def _closed(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for k in self.free[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the template stands anywhere in the words."""
        active: set[int] = set()
        for word in words:
            if self.open or word in self.first:
                active |= self.reach[0]
            after: set[int] = set()
            for state in active:
                if (to := self.on[state].get(word)) is not None:
                    after |= self.reach[to]
                if (to := self.any[state]) is not None:
                    after |= self.reach[to]
            if self.end in after:
                return True
            active = after
        return False


class Scanner:
    """Compiled phrases and templates."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> None:
        self.phrases = [([w.encode() for w in words_of(p)], label) for p, label in phrases]
        parts = [(parsed(markup), label) for label, markup in templates]
        # A text without one of the mandatory words as a substring cannot match; the longest words are rarest.
        self.templates = [(Automaton(p), label, [w.encode() for w in sorted(mandatory(p), key=len, reverse=True)[:4]]) for p, label in parts]

    def scan(self, text: bytes) -> tuple[int, int | None, int | None, str, str]:
        """Places of phrases, their first and last start, base labels, all labels; of lower-cased bytes."""
        phrases = [x for x in self.phrases if all(w in text for w in x[0])]
        templates = [x for x in self.templates if all(w in text for w in x[2])]
        if not phrases and not templates:
            return 0, None, None, "", ""
        words = _WORD.findall(text)
        starts, labels = [], set()
        for phrase, label in phrases:
            size = len(phrase)
            found = [k for k, w in enumerate(words) if w == phrase[0] and words[k : k + size] == phrase]
            starts += found
            if found:
                labels.add(label)
        more = {label for automaton, label, _ in templates if automaton.accepts(words)}
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


@lru_cache(maxsize=4)
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


_FOUND = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string()}


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: counts, first and last place, labels and a score.

    The score is 1 where templates add a label, 0.5 where phrases give all labels, 0 without any. No shuffle.
    """
    phrases, templates = tuple(phrases), tuple(templates)

    def scanned(texts: pa.Array) -> pa.Array:
        tool = scanner(phrases, templates)
        columns: dict[str, list] = {name: [] for name in _FOUND}
        for s in slices(texts, _WORD_BYTES, lower=True):
            raw = s.data.tobytes()
            columns["n_words"] += np.diff(s.word_at).tolist()
            for k in range(s.n):
                places, first, last, base, labels = tool.scan(raw[s.text_at[k] : s.text_at[k + 1]])
                for name, value in (("n_base", places), ("first_word", first), ("last_word", last), ("base_labels", base), ("labels", labels)):
                    columns[name].append(value)
        return pa.StructArray.from_arrays([pa.array(columns[n], t) for n, t in _FOUND.items()], list(_FOUND))

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    find = F.arrow_udf(scanned, T.StructType([T.StructField(n, kinds[t]) for n, t in _FOUND.items()])).asNondeterministic()
    rows = in_small_batches(docs).select("doc_id", find(F.col("text")).alias("f")).select("doc_id", "f.*")
    return rows.withColumn("score", F.when(F.col("labels") == "", 0.0).when(F.col("labels") == F.col("base_labels"), 0.5).otherwise(1.0))

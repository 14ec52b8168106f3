"""Licence scan by a generalised suffix automaton of licence tokens.

The automaton holds all factors of all templates. Each text is streamed through it once; at every
word the state and length are the matching statistic: the longest run of words ending there that
occurs in some template; the suffix links name the shorter runs that other templates hold. A run is an
anchor in a template where neither side goes on there. Anchors in the same order in text and template,
close to each other, are chained, each with its best predecessor, and a chain that covers enough of a
template is a span and gives the template's label.

Base phrases are templates of the automaton too: a phrase ends at a word iff its state is the
current one or a suffix-link ancestor of it, and the match is as long as the phrase.

The automaton is small and fixed, so it is broadcast; texts are scanned where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Grants, notices and whole texts of common public licences, by label (fixed values; case and punctuation do not count).
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.""",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        """This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along
        with this library""",
    ],
    "agpl": [
        "it under the terms of the gnu affero general public license as published by the free software foundation",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "bsd": [
        "licensed under the bsd 3 clause license",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "mpl": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at http://mozilla.org/MPL/2.0/.""",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ],
}

#: Words of a match that anchors a chain, words between chained matches, share of a template that counts.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered: runs of digits, a-z and everything from U+0080."""
    return WORD.findall((text or "").encode().lower())


@dataclass
class Automaton:
    """Generalised suffix automaton over numbered words.

    next, link, length by state; places: (template, position, length) at which a state's words or a suffix of them end;
    phrases: base phrases (number, words) that end wherever the state does.
    """

    templates: list[tuple[str, list[bytes]]]
    base: list[tuple[str, list[bytes]]]
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        self.number: dict[bytes, int] = {}
        ends: list[set] = [set()]
        for t, (_, tokens) in enumerate([*self.templates, *self.base]):
            last = 0
            for pos, token in enumerate(tokens):
                last = self._extend(last, self.number.setdefault(token, len(self.number)))
                ends += [set() for _ in range(len(self.next) - len(ends))]
                if t < len(self.templates):
                    ends[last].add((t, pos))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        # of each state: the places in templates at which a suffix of MIN_MATCH words or more ends, with its longest length there
        # (None: the whole match), from the state and its suffix links
        own: list[list[tuple[int, int, int | None]]] = [[] for _ in ends]
        for s in range(1, len(self.next)):
            seen, at, length = set(), s, None
            while at > 0 and (length is None or length >= MIN_MATCH):
                own[s] += [(t, pos, length) for t, pos in sorted(ends[at] - seen)]
                seen |= ends[at]
                at = self.link[at]
                length = self.length[at]
        self.places = own
        at: dict[int, list[tuple[int, int]]] = {}
        for k, (_, tokens) in enumerate(self.base):
            s = 0
            for token in tokens:
                s = self.next[s][self.number[token]]
            at.setdefault(s, []).append((k, len(tokens)))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrases[s] = (*self.phrases[self.link[s]], *at.get(s, ()))

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def statistics(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of every word that has a match; words outside all templates end one."""
        find, following, link, length = self.number.get, self.next, self.link, self.length
        state = held = 0
        before = -1
        for i, c in enumerate(map(find, tokens)):
            if c is None:
                continue
            if i != before + 1:
                state = held = 0
            before = i
            while state and c not in following[state]:
                state = link[state]
                held = length[state]
            if c in following[state]:
                state = following[state][c]
                held += 1
                yield i, state, held

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Base places (start, phrase number), and spans (label, template, first word, last word, cover)."""
        base, anchors = [], {}
        for i, state, held in self.statistics(tokens):
            for k, n in self.phrases[state]:
                if held >= n:
                    base.append((i - n + 1, k))
            if held >= MIN_MATCH:
                self._anchor(anchors, i, state, held, tokens[i + 1] if i + 1 < len(tokens) else None)
        return base, [s for t, found in sorted(anchors.items()) for s in self._chains(t, found)]

    def _anchor(self, anchors: dict, i: int, state: int, held: int, following: bytes | None) -> None:
        """Runs that end at word i in some template and do not go on there."""
        for t, pos, n in self.places[state]:
            words_ = self.templates[t][1]
            if following is None or pos + 1 == len(words_) or words_[pos + 1] != following:
                n = held if n is None else min(n, held)
                anchors.setdefault(t, []).append((i - n + 1, pos - n + 1, n))

    def _chains(self, t: int, anchors: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """Disjoint chains of anchors (text start, template start, words) that cover enough of template t, the fullest first.

        An anchor follows the predecessor with which its chain covers most; a template has few places for each word of
        the text, and only anchors that end within MAX_GAP words before can be predecessors.
        """
        label, tokens = self.templates[t]
        anchors = sorted(set(anchors))
        covered, before, lo, reach = [], [], 0, MAX_GAP + len(tokens)
        for k, (x, p, n) in enumerate(anchors):
            best, via = n, -1
            while anchors[lo][0] + reach < x:
                lo += 1
            for j in range(lo, k):
                y, r, m = anchors[j]
                if y < x and r < p and y + m < x + n and r + m < p + n and x - (y + m) <= MAX_GAP and p - (r + m) <= MAX_GAP:
                    total = covered[j] + n - max(0, y + m - x, r + m - p)
                    if total > best:
                        best, via = total, j
            covered.append(best)
            before.append(via)
        taken: list[tuple[int, int]] = []
        for k in sorted(range(len(anchors)), key=lambda k: (-covered[k], k)):
            if covered[k] < MIN_COVER * len(tokens):
                break
            first = k
            while before[first] >= 0:
                first = before[first]
            lo_, hi = anchors[first][0], anchors[k][0] + anchors[k][2] - 1
            if all(hi < a or lo_ > b for a, b in taken):
                taken.append((lo_, hi))
                yield label, t, lo_, hi, covered[k] / len(tokens)


def automaton(templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> Automaton:
    """Automaton of licence templates (label: texts) and base phrases (phrase: label)."""
    templates = TEMPLATES if templates is None else templates
    base = BASE if base is None else base
    return Automaton([(label, words(t)) for label, texts in templates.items() for t in texts], [(label, words(p)) for p, label in base.items()])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,last:int,cover:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cover", pa.float64())]))


def scan(docs: DataFrame, machine: Automaton | None = None) -> DataFrame:
    """One row per document, over its whole text (null: empty).

    n_words; n_base (all places of base phrases); first_word and last_word (their smallest and
    largest start, null without any); base_labels and labels (distinct, sorted, comma-joined; labels
    adds those of covered templates); score: 1 with a base phrase, else the best cover of a
    template, else 0; spans: label, first and last word, and cover of each chain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine or automaton())

    def run(batches):
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                tokens = words(text.as_py())
                base, spans = m.scan(tokens)
                mine = {m.base[k][0] for _, k in base}
                score = 1.0 if base else max((s[4] for s in spans), default=0.0)
                starts = [s for s, _ in base]
                rows.append((
                    len(tokens), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | {s[0] for s in spans})),
                    score, [{"label": s[0], "first": s[2], "last": s[3], "cover": s[4]} for s in spans],
                ))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

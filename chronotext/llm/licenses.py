"""License scans: template markup compiled to automata over tokens.

A template is wording with two kinds of markup:

* `[ ... ]` is optional: it is there as written, or not at all; it may contain markup;
* `{n}` is replaceable: any words, at most n; `{a|b c|}` is replaceable by one of the phrases, here also by none.

All other words are mandatory and must match exactly, in order, without words between; case and punctuation don't count. A compiled
template is a
nondeterministic automaton; a text is accepted where a run from some word reaches the end. An automaton runs on texts only that
have its rarest mandatory word, so most texts are only counted.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters.

Defined cases: null is the empty text: no words, no labels. Repeated rows are scanned one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronotext.llm.common import map_slices

#: The phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and template of license texts, notices and grants; the wording is that of the published licenses.
TEMPLATES = [
    ("mit", "{released|licensed|distributed|available|made available} under the [terms of the] MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [(the "Software")], to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [(including the next paragraph)] shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {12} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [the Software] to deal in the Software without restriction"),
    ("isc", """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {8} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {8} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [1.] Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {12} BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES [(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION)] HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY"""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [1.] Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. [3.] Neither the name of {12} nor the names of {its|the|their|}
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the {author|authors} be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [1.] The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license [(the "Software")]
        to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. [Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.]"""),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 [(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        {http|https}://www.apache.org/licenses/LICENSE-2.0 [Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.]]"""),
    ("gpl-3.0", "{licensed|released|distributed|redistribute it and/or modify it} under the [terms of the] GNU General Public License {version|v|as published by the Free Software Foundation, either version} 3"),
    ("gpl-2.0", "{licensed|released|distributed|redistribute it and/or modify it} under the [terms of the] GNU General Public License {version|v|as published by the Free Software Foundation; either version} 2"),
    ("lgpl-3.0", "under the [terms of the] GNU Lesser General Public License {version|v|as published by the Free Software Foundation, either version|} 3"),
    ("agpl-3.0", "under the [terms of the] GNU Affero General Public License {version|v|as published by the Free Software Foundation, either version|} 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "licensed under {a|the} Creative Commons Attribution 4.0 [International] License"),
    ("cc-by-sa-4.0", "licensed under {a|the} Creative Commons Attribution-ShareAlike 4.0 [International] License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("custom", "All rights reserved {6} this software may not be {copied|reproduced|redistributed} without {prior|written|prior written|the prior written} permission"),
]
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_IS_WORD = np.array([c != 32 for c in _FOLD], bool)


@dataclass
class Automaton:
    """States are numbers; `step` maps a state and word to states, `any_word` a state to one that any word leads to, `free` a
    state to those that need no word."""

    label: str
    step: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    start: int = 0
    end: int = 0
    anchor: bytes = b""

    def state(self) -> int:
        self.step.append({})
        self.any_word.append(None)
        self.free.append([])
        return len(self.step) - 1

    def word(self, at: int, word: str) -> int:
        to = self.state()
        self.step[at].setdefault(word.encode(), []).append(to)
        return to

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accepts_from(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words that starts at `at`."""
        now, best = self.closure({self.start}), None
        while now:
            if self.end in now:
                best = at
            if at == len(words):
                break
            then = {to for s in now for to in self.step[s].get(words[at], ())} | {self.any_word[s] for s in now if self.any_word[s] is not None}
            now, at = self.closure(then), at + 1
        return best

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """All (first word, end) of accepted runs, the longest from each start."""
        first = {w for s in self.closure({self.start}) for w in self.step[s]}
        wild = any(self.any_word[s] is not None for s in self.closure({self.start}))
        found = ((i, self.accepts_from(words, i)) for i, w in enumerate(words) if wild or w in first)
        return [(i, e) for i, e in found if e is not None and e > i]


def _fold(text: str) -> list[str]:
    return text.encode().translate(_FOLD).decode().split()


def _tokens(template: str) -> list[str]:
    out, at = [], 0
    while at < len(template):
        c = template[at]
        if c in "[]":
            out.append(c)
            at += 1
        elif c == "{":
            stop = template.index("}", at)
            out.append(template[at : stop + 1])
            at = stop + 1
        elif c.isspace():
            at += 1
        else:
            stop = min([i for i in (template.find(x, at) for x in "[]{") if i >= 0], default=len(template))
            out += _fold(template[at:stop])
            at = stop
    return out


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    a.start = at = a.state()
    opened: list[int] = []
    mandatory: list[str] = []
    for token in _tokens(template):
        if token == "[":
            opened.append(at)
        elif token == "]":
            a.free[opened.pop()].append(at)
        elif token[0] == "{" and token[1:-1].isdigit():
            stop = a.state()
            a.free[at].append(stop)
            for _ in range(int(token[1:-1])):
                a.any_word[at] = to = a.state()
                a.free[to].append(stop)
                at = to
            at = stop
        elif token[0] == "{":
            stop = a.state()
            for phrase in token[1:-1].split("|"):
                to = at
                for word in _fold(phrase):
                    to = a.word(to, word)
                a.free[to].append(stop)
            at = stop
        else:
            at = a.word(at, token)
            if not opened:
                mandatory.append(token)
    if opened:
        raise ValueError(f"an optional region of {label} is not closed")
    a.end, a.anchor = at, max(mandatory, key=len, default="").encode()
    return a


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a template is accepted, 0.5 where only a phrase of the base stands, else 0."""
    names = ["n_words", "n_base", "first_word", "last_word"]
    keep = [k for k in keep or ["doc_id"] if k not in (*names, "base_labels", "labels", "score")]
    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double")
    templates = TEMPLATES if templates is None else templates

    def make():
        automata = [compile_template(*t) for t in templates]
        base = [(phrase.encode().split(), label) for phrase, label in BASE.items()]
        anchors = {max(words, key=len) for words, _ in base} | {a.anchor for a in automata}

        def one(folded: bytes) -> tuple[int, int | None, int | None, str, str, float]:
            if not any(x in folded for x in anchors):
                return 0, None, None, "", "", 0.0
            words = folded.split()
            places, labels = [], set()
            for phrase, label in base:
                if phrase[0] in folded:
                    own = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                    places += own
                    labels |= {label} if own else set()
            accepted = {a.label for a in automata if a.anchor in folded and a.find(words)}
            score = 1.0 if accepted else 0.5 if labels else 0.0
            return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | accepted)), score

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            folded = [(t or "").encode("utf-8", "replace").translate(_FOLD) for t in piece["text"].to_pylist()]
            sizes = np.fromiter((len(f) + 1 for f in folded), np.int64, len(folded))
            flat = _IS_WORD[np.frombuffer(b" ".join([*folded, b""]), np.uint8)]
            begins = flat & ~np.concatenate([[False], flat[:-1]])
            ends = np.cumsum(sizes)
            counts = np.diff(np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], ends])])
            got = [one(f) for f in folded]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            return pa.record_batch([*[piece[k] for k in keep], pa.array(counts), *cols], [*keep, *names, "base_labels", "labels", "score"])

        return work

    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), "text", make, schema)

"""License scans as an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in the whole corpus, rarest first, counted in Spark for the
templates' tokens.  A template of n words meets blocks of W words, the least power of two that is
2n or more, taken each W / 2 words, so each stretch of n words lies whole in one; a text's last
block may be shorter.  A block meets a template if it holds ``CONTAINED`` or more of the template's
distinct tokens and all of its naming words: in a notice of a few words four fifths are common to
all licenses, and the name is what is left.  Filters that lose nothing: a match must hold one of the
template's first ``n - need + 1`` tokens in that order, or its rarest naming word (prefix; templates
are found by it), have ``need`` distinct tokens (length), and from the first common token on both
sides must have enough tokens left (position).  What passes is counted exactly.

Phrases (label, words) are counted beside this at every place where their words stand in a row.

Edge cases: null and empty texts have 0 words, no labels and score 0; texts of any length are
scanned whole; repeated rows give equal rows; without documents all frequencies are 0 and ties in
frequency go by the token; a template without words, or
without one of its naming words, is refused.  Columns but doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.arrays import PROSE, ascii_lower, chunks, flat, span_hash, spans

CONTAINED = 0.8
#: Phrases of public licenses and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices and whole texts of public licenses.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
# Label, text, and the words without which a short text is not this license.
TEMPLATES = [
    ("mit", MIT, ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ""),
    ("mit-notice", "Released under the MIT License", "mit license"),
    ("isc", ISC, ""),
    ("bsd-3-clause", BSD, ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("zlib", ZLIB, ""),
    ("unlicense", UNLICENSE, ""),
    ("apache-2.0", APACHE_HEADER, ""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("gpl", GPL_HEADER, ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
]
# End of fixed values.


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, and each text's n+1 offsets; a word is a run of 0-9, a-z and non-ASCII."""
    buf, offsets = flat(texts)
    buf = ascii_lower(buf)
    start, end, doc = spans(PROSE[buf], offsets)
    return span_hash(buf, start, end), np.searchsorted(doc, np.arange(len(texts) + 1))


def hashes(text: str) -> np.ndarray:
    return words_of(pa.array([text]))[0]


def frequencies(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """Occurrences in the corpus of each of the templates' tokens: a bounded list, summed in Spark."""
    tokens = np.unique(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tokens.size, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                words, _ = words_of(part.column("text"))
                at = np.minimum(np.searchsorted(tokens, words), tokens.size - 1)
                total += np.bincount(at[tokens[at] == words], minlength=tokens.size)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(total)], names=["token", "n"])

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token & (1 << 64) - 1: r.n for r in found}


def block_words(template_words: int) -> int:
    return 1 << (2 * template_words - 1).bit_length()


class Join:
    """The templates' side for one size of blocks: tokens in the global order, needed overlaps, templates by prefix token."""

    def __init__(self, templates: list[tuple[str, np.ndarray, np.ndarray]], freq: dict[int, int]):
        self.templates, self.by_token = [], {}
        for label, words, naming in templates:
            ordered = sorted(set(words.tolist()), key=lambda x: (freq.get(x, 0), x))
            need = int(np.ceil(CONTAINED * len(ordered) - 1e-9))
            named = [x for x in ordered if x in set(naming.tolist())]
            for x in named[:1] or ordered[: len(ordered) - need + 1]:
                self.by_token.setdefault(x, []).append(len(self.templates))
            self.templates.append((label, ordered, need, named))
        self.prefix = np.unique(np.array(list(self.by_token), dtype=np.uint64))
        self.order = {x: (freq.get(x, 0), x) for _, ordered, _, _ in self.templates for x in ordered}

    def block(self, words: np.ndarray) -> list[tuple[str, float]]:
        have = set(words.tolist())
        known = sorted(have & self.order.keys(), key=self.order.__getitem__)
        place, out = {x: i for i, x in enumerate(known)}, []
        for t in {t for x in known for t in self.by_token.get(x, ())}:
            label, tokens, need, named = self.templates[t]
            if len(have) < need or not have.issuperset(named):
                continue
            first = next(i for i, x in enumerate(tokens) if x in have)
            if min(len(tokens) - first, len(known) - place[tokens[first]]) < need:
                continue
            both = sum(x in have for x in tokens)
            if both >= need:
                out.append((label, both / len(tokens)))
        return out


def joins(templates: list[tuple[str, str, str]], freq: dict[int, int]) -> dict[int, Join]:
    """By the words of a block."""
    by_size: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
    for label, text, naming in templates:
        words, names = hashes(text), hashes(naming)
        if not words.size or not np.isin(names, words).all():
            raise ValueError(f"a template of {label} has no words, or lacks naming ones")
        by_size.setdefault(block_words(words.size), []).append((label, words, names))
    return {size: Join(own, freq) for size, own in sorted(by_size.items())}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``docs(doc_id, text)`` -> a row each: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment met)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    freq = frequencies(docs, np.concatenate([hashes(t) for _, t, _ in templates]))
    join = docs.sparkSession.sparkContext.broadcast((joins(templates, freq), [(hashes(p), label) for p, label in phrases.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, sought = join.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words, at = words_of(part.column("text"))
                n = part.num_rows
                base: list[set[str]] = [set() for _ in range(n)]
                count, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                for phrase, label in sought:
                    if words.size < phrase.size:
                        continue
                    k = words.size - phrase.size + 1
                    here = np.flatnonzero(words[:k] == phrase[0])
                    for j in range(1, phrase.size):
                        here = here[words[here + j] == phrase[j]]
                    doc = np.searchsorted(at, here, side="right") - 1
                    inside = here + phrase.size <= at[doc + 1]
                    for w, d in zip(here[inside], doc[inside], strict=True):
                        base[d].add(label)
                        count[d] += 1
                        p = int(w - at[d])
                        low[d] = p if low[d] < 0 else min(low[d], p)
                        high[d] = max(high[d], p)
                labels, score = [set(b) for b in base], np.zeros(n)
                for size, side in sides.items():
                    rare = np.minimum(np.searchsorted(side.prefix, words), side.prefix.size - 1)
                    hits = np.flatnonzero(side.prefix[rare] == words)
                    doc, half = np.searchsorted(at, hits, side="right") - 1, size // 2
                    place = (hits - at[doc]) // half
                    blocks = np.concatenate([np.stack([doc, np.maximum(place - k, 0)], axis=1) for k in (0, 1)])
                    for d, b in np.unique(blocks, axis=0):
                        for label, s in side.block(words[at[d] + b * half : min(at[d] + b * half + size, at[d + 1])]):
                            labels[d].add(label)
                            score[d] = max(score[d], s)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

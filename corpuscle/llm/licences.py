"""Licence scan: normalised text compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import hash_words, shingles, slices, take, words_of

#: Least coefficient of a match.
THRESHOLD = 0.8

# Public licence notices, as their stewards word them.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normal form: lower case, marks dropped, a hyphen or slash between letters kept as one word."""
    offsets, codes, words = words_of(text)
    bare = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.string())), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    used = np.asarray(pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False), bool)
    keep = used[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets].astype(np.int64), (hash_words(bare)[codes[keep]] if len(codes) else np.zeros(0, np.uint64))


class Templates:
    """Bigram sets of the templates, ordered by size so that a text's size bounds pick a range of them."""

    def __init__(self, notices: dict[str, list[str]]) -> None:
        named = [(name, text) for name, texts in notices.items() for text in texts]
        at, grams = shingles(*_words(pa.array([t for _, t in named])), 2)
        sets = sorted(((np.unique(grams[at[i] : at[i + 1]]), name, at[i + 1] - at[i]) for i, (name, _) in enumerate(named)), key=lambda x: len(x[0]))
        self.names = [n for _, n, _ in sets]
        self.sizes = np.array([len(s) for s, _, _ in sets])
        self.runs = np.array([n for _, _, n in sets])  # bigrams with repeats
        flat = np.concatenate([s for s, _, _ in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner = flat[order], owner[order]

    def best(self, offsets: np.ndarray, grams: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Best template of each unit (-1: none) and its coefficient.

        2 |A & B| / (|A| + |B|) >= t needs |B| between |A| t / (2 - t) and |A| (2 - t) / t.
        """
        units = len(offsets) - 1
        best, score = np.full(units, -1), np.zeros(units)
        sizes = np.diff(offsets)
        unit = np.repeat(np.arange(units), sizes)
        lo = np.searchsorted(self.gram, grams)
        hit = np.zeros(len(grams), bool)
        inside = lo < len(self.gram)
        hit[inside] = self.gram[lo[inside]] == grams[inside]
        # |A & B| >= |B| t / (2 - t), and it is at most the unit's bigrams that some template has
        some = np.nonzero(np.bincount(unit[hit], minlength=units) >= max(1, self.sizes.min(initial=1) * least / (2 - least) - 1e-9))[0]
        for u in some.tolist():
            a = np.unique(grams[offsets[u] : offsets[u + 1]])
            first, last = np.searchsorted(self.sizes, np.ceil(len(a) * least / (2 - least) - 1e-9)), np.searchsorted(self.sizes, np.floor(len(a) * (2 - least) / least + 1e-9), "right")
            if first >= last:
                continue
            x, y = np.searchsorted(self.gram, a), np.searchsorted(self.gram, a, "right")
            shared = np.zeros(len(self.sizes), np.int64)
            for p, q in zip(x[y > x].tolist(), y[y > x].tolist(), strict=True):
                shared[self.owner[p:q]] += 1
            dice = 2 * shared[first:last] / (len(a) + self.sizes[first:last])
            k = int(dice.argmax())
            if dice[k] >= least - 1e-12:
                best[u], score[u] = first + k, dice[k]
        return best, score

    def windows(self, offsets: np.ndarray, grams: np.ndarray, taken: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """Notices inside texts: text, first bigram, template, coefficient.

        A window has as many words as the template and begins with one of its bigrams (at the text's end it may have
        fewer). Windows with a ``taken`` bigram are left out; of those that overlap, the best one stays, of equal ones
        the longer.
        """
        lo, hi = np.searchsorted(self.gram, grams), np.searchsorted(self.gram, grams, "right")
        many = np.where(taken, 0, hi - lo)
        place = np.repeat(np.arange(len(grams)), many)
        template = self.owner[np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        order = np.lexsort((place, template))
        place, template = place[order], template[order]
        text = np.searchsorted(offsets, place, "right") - 1
        # a window's |A & B| is at least |B| t / (2 - t): so many of the template's bigrams lie within its length
        need = np.maximum(1, np.ceil(self.sizes * least / (2 - least) - 1e-9).astype(np.int64))[template]
        last = np.arange(len(place)) + need - 1
        inside = last < len(place)
        last[~inside] = 0
        may = inside & (template[last] == template) & (text[last] == text) & (place[last] - place < self.runs[template])
        sets = [self.gram[self.owner == t] for t in range(len(self.sizes))]
        good: dict[int, list[tuple[float, int, int, int, int]]] = {}
        for p, t, d in zip(place[may].tolist(), template[may].tolist(), text[may].tolist(), strict=True):
            end = min(p + int(self.runs[t]), int(offsets[d + 1]))
            if taken[p:end].any():
                continue
            a = np.unique(grams[p:end])
            dice = 2 * int(np.isin(a, sets[t], assume_unique=True).sum()) / (len(a) + int(self.sizes[t]))
            if dice >= least - 1e-12:
                good.setdefault(d, []).append((-dice, -int(self.runs[t]), p, end, t))
        out = []
        for d, found in sorted(good.items()):
            used = np.zeros(int(offsets[d + 1] - offsets[d]), bool)
            base = int(offsets[d])
            for dice, _, p, end, t in sorted(found):
                if not used[p - base : end - base].any():
                    used[p - base : end - base] = True
                    out.append((d, p, t, -dice))
        return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("licence", pa.string()), ("score", pa.float64())])


def _scan(it: Iterator[pa.RecordBatch], notices: dict[str, list[str]], least: float, inside: bool) -> Iterator[pa.RecordBatch]:
    templates = Templates(notices)
    for whole in it:
        for batch in slices(whole):
            text, ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            lines = pc.split_pattern(text, "\n")
            counts = np.diff(lines.offsets.to_numpy())
            doc = np.repeat(np.arange(len(text)), counts)
            first = np.cumsum(counts) - counts
            nth = np.arange(len(doc)) - np.repeat(first, counts)
            in_lines, words = _words(lines.flatten())
            in_texts = in_lines[np.append(first, len(doc))]  # a text's words are those of its lines
            at, grams = shingles(in_texts, words, 2)
            line_best, line_score = templates.best(*shingles(in_lines, words, 2), least)
            best, score = templates.best(at, grams, least)
            best = np.where(counts > 1, best, -1)  # a text of one line is that line
            rows = [(doc[i], nth[i], line_best[i], line_score[i]) for i in np.nonzero(line_best >= 0)[0]] + [(i, -1, best[i], score[i]) for i in np.nonzero(best >= 0)[0]]
            if inside:
                # bigrams that begin in a found line or text are taken, and the one that ends at a found line's first word
                taken_word = np.repeat(line_best >= 0, np.diff(in_lines)) | np.repeat(best >= 0, np.diff(in_texts))
                owner = np.repeat(np.arange(len(text)), np.diff(at))
                word = np.arange(len(grams)) - at[owner] + in_texts[owner]
                taken = taken_word[word] | taken_word[np.minimum(word + 1, in_texts[owner + 1] - 1)] if len(grams) else np.zeros(0, bool)
                for d, p, t, x in templates.windows(at, grams, taken, least):
                    rows.append((d, nth[np.searchsorted(in_lines, word[p], "right") - 1], t, x))
            docs, place, of, scores = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs, pa.int64())), pa.array(place, pa.int64()), pa.array([templates.names[i] for i in of], pa.string()), pa.array(scores, pa.float64())], schema=_FOUND)


def licences(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, threshold: float = THRESHOLD, inside: bool = True) -> DataFrame:
    """Licence notices in documents (doc_id, text): doc_id, line (from 0; -1: the whole text), licence, score.

    Every line, and the whole text, is compared with the templates by 2 |A & B| / (|A| + |B|) over the sets of word
    bigrams of the normal form (lower case, marks dropped); a single word is its own bigram. Templates whose size makes
    the threshold unreachable are not compared, and of the rest only those that share a bigram. The best template is
    returned, of equal ones the smaller and then the earlier. With ``inside``, notices that are wrapped over lines or
    stand beside other words are found too: windows of a template's number of words, across lines, that do not touch a
    line or text found whole; ``line`` is that of the first word. Whole licences that are not templates (Apache-2.0,
    GPL) are found by the notice they contain. One pass, no shuffle; the templates are a fixed table.
    A null or empty text or line matches nothing; repeated rows each give theirs; an empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, notices, threshold, inside), "doc_id long, line long, licence string, score double")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licences(take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))

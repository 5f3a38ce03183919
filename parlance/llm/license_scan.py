"""License notices in texts: MinHash bands over windows, then exact containment.

Templates and texts are lower-cased words without punctuation and their five-word
shingles (a shorter template is one shingle).  A template of fewer than ``SMALLEST``
shingles is looked up by its shingles themselves, which is exact: no window is as short as
it is.  For the others, windows of a text overlap by three quarters and come in sizes that
double; a template is looked up among windows of at least its own size and less than four
times it, so that some window of at most 8/3 of its shingles holds any occurrence whole.
Every window has a MinHash signature of ``BANDS`` bands of ``ROWS`` rows; equal bands
retrieve templates.  A window that holds three quarters of a template has Jaccard similarity
of 0.75 / (8/3 + 0.25) = 0.257 with it or more, so with ROWS = 1 and 64 bands it is
retrieved with probability 1 - (1 - 0.257)**64 > 0.99999999.  A retrieved template is verified
by exact containment: the greatest share of its distinct shingles inside any stretch of
the text of its own length; 0.75 or more is a match.

Only windows that hold a shingle of some template at all can match, so the others get no
signature; that test is exact.  Templates are a bounded parameter and go with the code;
texts stay where they are, nothing is shuffled.

Defined cases: a null or empty text has no match; a notice repeated in a text is one match
with its first place; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import bytekit as bk

WORDS, CONTAINMENT = 5, 0.75
BANDS, ROWS, SMALLEST = 64, 1, 16

#: Short notices of public licenses, as their texts ask to be applied.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Letters, digits and bytes of longer characters stay (lower case); all others separate words.
_NORMAL = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _NORMAL[_b] = _b
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 0x20


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """One hash for each position where a whole shingle begins."""
    n = max(0, len(h) - words + 1)
    s = np.full(n, words, np.uint64)
    for k in range(words):
        s = bk.mix(s * np.uint64(0x9E3779B97F4A7C15) ^ h[k : k + n])
    return s


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = _NORMAL[buf]
    start, end, first = bk.words(buf, offs)
    return bk.word_hashes(buf, start, end), first


_rng = np.random.default_rng(20240301)
_SALTS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingles."""
    least = np.array([bk.mix(s ^ salt).min() for salt in _SALTS]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = bk.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least[:, r])
    return key


class Index:
    """Templates by band key; a bounded parameter."""

    def __init__(self, templates: dict[str, str], words: int = WORDS):
        self.names = list(templates)
        self.sets: list[np.ndarray] = []
        self.length: list[int] = []
        self.words: list[int] = []
        self.bands: dict[tuple[int, int], list[int]] = {}
        for i, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _ = word_hashes(raw, np.array([0, len(raw)]))
            k = min(words, len(h))  # a template of fewer words is one shingle
            s = np.unique(shingles(h, k))
            self.sets.append(s)
            self.length.append(len(h))
            self.words.append(k)
            for key in signature(s):
                self.bands.setdefault(int(key), []).append(i)
        self.kinds = sorted(set(self.words))
        self.all = {k: np.unique(np.concatenate([s for s, w in zip(self.sets, self.words, strict=True) if w == k])) for k in self.kinds}

    def contained(self, i: int, s: np.ndarray) -> tuple[float, int]:
        """The greatest share of template i inside a stretch of its own length, and where the first such begins."""
        own = self.sets[i]
        at = np.searchsorted(own, s)
        at[at == len(own)] = 0
        hit = np.flatnonzero(own[at] == s)
        width = self.length[i] - self.words[i] + 1
        best, place, counts, left, distinct = 0, -1, {}, 0, 0
        for p in hit.tolist():
            e = int(at[p])
            counts[e] = counts.get(e, 0) + 1
            distinct += counts[e] == 1
            while hit[left] <= p - width:
                gone = int(at[hit[left]])
                counts[gone] -= 1
                distinct -= counts[gone] == 0
                left += 1
            if distinct > best:
                best, place = distinct, int(hit[left])
        return best / len(own), place

    def scan(self, h: np.ndarray) -> list[tuple[str, float, int]]:
        """Matches in the words of one text: template, containment, first word."""
        found: dict[int, tuple[float, int]] = {}
        for k in self.kinds:
            s = shingles(h, k)
            if not len(s):
                continue
            every = self.all[k]
            at = np.minimum(np.searchsorted(every, s), len(every) - 1)
            known = np.flatnonzero(every[at] == s)
            if not len(known):
                continue
            # Few shingles: enough of them anywhere in the text.
            held = np.unique(s[known])
            few = {i for i, own in enumerate(self.sets) if len(own) < SMALLEST}
            wanted = {i for i in few if self.words[i] == k and np.isin(self.sets[i], held).sum() >= CONTAINMENT * len(self.sets[i])}
            longest = max(n for n, w in zip(self.length, self.words, strict=True) if w == k)
            size = SMALLEST
            while size <= max(SMALLEST, 4 * longest):
                step = size // 4
                tried = [i for i, n in enumerate(self.length) if self.words[i] == k and i not in wanted and i not in few and n <= size < 4 * n]
                if tried:
                    for w in sorted({b for p in known.tolist() for b in range(max(0, p // step - 3), p // step + 1)}):
                        part = s[w * step : w * step + size]
                        wanted.update(i for key in signature(np.unique(part)).tolist() for i in self.bands.get(key, ()) if i in tried)
                size *= 2
            for i in wanted:
                share, place = self.contained(i, s)
                if share >= CONTAINMENT:
                    found[i] = (share, place)
        return [(self.names[i], *found[i]) for i in sorted(found)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and template that it holds: doc_id, license, containment, first_word."""
    docs = bk.bounded_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                h, first = word_hashes(buf, offs)
                # Documents without any template shingle are done at once.
                some = np.zeros(len(offs), bool)
                for k in index.kinds:
                    s = shingles(h, k)
                    at = np.minimum(np.searchsorted(index.all[k], s), len(index.all[k]) - 1)
                    some[np.searchsorted(first, np.flatnonzero(index.all[k][at] == s), "right") - 1] = True
                rows = [(i, *m) for i in np.flatnonzero(some[:-1]).tolist() for m in index.scan(h[first[i] : first[i + 1]])]
                at, name, share, place = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(place, pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return bk.map_arrow(docs, run, f"doc_id {kind}, license string, containment double, first_word long")


def brute_force(text: str, templates: dict[str, str], words: int = WORDS) -> dict[str, float]:
    """Containment of every template at every place, for tests."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    w, out = split(text or ""), {}
    for name, t in templates.items():
        v = split(t)
        k = min(words, len(v))
        own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        s = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        width = len(v) - k + 1
        best = max((len(own & set(s[i : i + width])) for i in range(len(s))), default=0) / len(own)
        if best >= CONTAINMENT:
            out[name] = best
    return out

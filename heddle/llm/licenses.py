"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates of equal length in words share windows of that length, taken at a stride of about an eighth of it.  Window and
template are shown by shingles of five words (a shorter template by its whole length), and by so many minima of hashed
shingles; a window meets a template if all minima of one band are equal.  Bands are chosen so that a window at the
lowest similarity that a match can have is met with the demanded probability.  A candidate is verified by the share of
the template's shingles found in the window, widened by the stride.

Templates are a parameter of bounded size (license texts), and travel to the tasks.  Defined results: null, blank and
too short texts have no match.  Rows are scanned each, repeated or not; an empty table gives an empty result; extra
columns are ignored.  Matches of one template that overlap are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from heddle.llm.common import small_batches, worker_state

#: Notices as they stand in files and pages, and whole short licenses; SPDX names.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-Rights-Reserved": "All rights reserved.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-license": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
SHINGLE = 5
STRIP = ".,;:!?\"'()[]{}<>*"


class WordHashes(dict):
    """64-bit hashes of words in lower case without marks at their ends; at most so many are held."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.strip(STRIP).lower())
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 100:
            self[word] = value
        return value


def word_hashes(text: str, table: dict) -> np.ndarray:
    parts = text.split()
    return np.fromiter(map(table.__getitem__, parts), dtype=np.uint64, count=len(parts))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def band_plan(similarity: float, wanted: float = 0.9999, rows: int = 1) -> int:
    """Bands of so many rows that meet a pair of this similarity with at least the wanted probability."""
    return max(1, math.ceil(math.log(1 - wanted) / math.log(1 - similarity**rows))) if similarity < 1 else 1


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = 0.8, rows: int = 1, seed: int = 7):
        self.containment = containment
        self.table = WordHashes()
        self.groups: dict[int, dict] = {}
        for name in sorted(templates):
            h = word_hashes(templates[name], self.table)
            if not len(h):
                continue
            n = min(SHINGLE, len(h))
            self.groups.setdefault(len(h), {"n": n, "names": [], "sets": []})
            g = self.groups[len(h)]
            g["names"].append(name)
            g["sets"].append(np.unique(shingles(h, n)))
        for size, g in self.groups.items():
            g["stride"] = stride = max(1, size // 8)
            count = size - g["n"] + 1
            # Worst case: the best window is half a stride off and a share of the template is lost to changes.
            common = max(1, containment * count - stride / 2) if count > 1 else 1
            g["bands"], g["rows"] = band_plan(common / (2 * count - common), rows=rows), rows
        most = max((g["bands"] * g["rows"] for g in self.groups.values()), default=0)
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {g["n"] for g in self.groups.values()}:
            known = np.unique(np.concatenate([x for g in self.groups.values() if g["n"] == n for x in g["sets"]]))
            bits = np.zeros(1 << 16, dtype=bool)
            bits[known & np.uint64(len(bits) - 1)] = True
            self.shingles[n] = bits, known
        self.mul = np.random.default_rng(seed).integers(1, 1 << 62, most, dtype=np.uint64) | np.uint64(1)
        for g in self.groups.values():
            keys: dict[int, list[int]] = {}
            g["minima"] = []
            for t, s in enumerate(g["sets"]):
                minima = np.array([self.mixed(s, i).min() for i in range(g["bands"] * g["rows"])], dtype=np.uint64)
                g["minima"].append(minima)
                for k in self.band_keys(minima[:, None], g)[:, 0].tolist():
                    keys.setdefault(k, []).append(t)
            g["keys"], g["of"] = np.array(sorted(keys), dtype=np.uint64), keys

    def mixed(self, s: np.ndarray, i: int) -> np.ndarray:
        x = s * self.mul[i]
        return x ^ (x >> np.uint64(32))

    def band_keys(self, minima: np.ndarray, g: dict) -> np.ndarray:
        """minima (hashes x windows) to keys (bands x windows); a key also tells its band."""
        out = []
        for b in range(g["bands"]):
            k = np.full(minima.shape[1], b + 1, dtype=np.uint64)
            for r in range(g["rows"]):
                k = (k ^ minima[b * g["rows"] + r]) * np.uint64(0x9E3779B97F4A7C15)
                k ^= k >> np.uint64(31)
            out.append(k)
        return np.array(out)

    def scan(self, text: str) -> list[tuple[str, int, float]]:
        """(template, first word of the window, containment) of every match."""
        return self.scan_many([text])[0]

    def scan_many(self, texts: list[str], most_words: int = 200_000) -> list[list[tuple[str, int, float]]]:
        """Matches of each text; texts are laid end to end, about most_words words at a time, so that numpy works on long columns."""
        out: list[list[tuple[str, int, float]]] = []
        held: list[np.ndarray] = []
        n = 0
        for t in texts:
            held.append(word_hashes(t, self.table) if t else np.zeros(0, dtype=np.uint64))
            n += len(held[-1])
            if n >= most_words:
                out.extend(self._laid(held))
                held, n = [], 0
        return out + (self._laid(held) if held else [])

    def _laid(self, parts: list[np.ndarray]) -> list[list[tuple[str, int, float]]]:
        """Matches of each text.  A text without a single shingle of any template has none: only the others are gone through."""
        kept = np.flatnonzero(self._touched(parts))
        out: list[list[tuple[str, int, float]]] = [[] for _ in parts]
        if len(kept):
            for k, found in zip(kept.tolist(), self._matched([parts[k] for k in kept.tolist()]), strict=True):
                out[k] = found
        return out

    def _touched(self, parts: list[np.ndarray]) -> np.ndarray:
        """Which texts hold a shingle of a template (and perhaps some that do not)."""
        ends = np.cumsum([len(p) for p in parts])
        h = np.concatenate(parts)
        out = np.zeros(len(parts), dtype=bool)
        for n, (bits, known) in self.shingles.items():
            if len(h) >= n:
                s = shingles(h, n)
                at = np.flatnonzero(bits[s & np.uint64(len(bits) - 1)])
                at = at[np.isin(s[at], known)]
                out[np.searchsorted(ends, at, side="right")] = True
        return out

    def _matched(self, parts: list[np.ndarray]) -> list[list[tuple[str, int, float]]]:
        """A window that reaches over a text's end is a candidate like others; it is verified on its own text's part only."""
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - [len(p) for p in parts]
        h = np.concatenate(parts)
        by_n: dict[int, np.ndarray] = {}
        mixed: dict[tuple[int, int], np.ndarray] = {}
        out: list[list[tuple[str, int, float]]] = [[] for _ in parts]
        for size, g in self.groups.items():
            n, stride = g["n"], g["stride"]
            if len(h) < n:
                continue
            s = by_n.setdefault(n, shingles(h, n))
            wide = size - n + 1
            if wide == 1:  # the one shingle is its own minimum in every band
                hits = [(int(p), t) for t, own in enumerate(g["sets"]) for p in np.flatnonzero(s == own[0])]
            else:
                starts = np.arange(0, max(1, len(s) - wide + stride), stride)
                starts = np.minimum(starts, max(0, len(s) - wide))
                minima = []
                for i in range(g["bands"] * g["rows"]):
                    if (n, i) not in mixed:
                        mixed[n, i] = self.mixed(s, i)
                    m = mixed[n, i]
                    minima.append(sliding_min(m, wide)[starts] if len(m) >= wide else np.array([m.min()]))
                keys = self.band_keys(np.array(minima), g)
                at = np.searchsorted(g["keys"], keys)
                found = g["keys"][np.minimum(at, len(g["keys"]) - 1)] == keys
                hits = [(int(starts[w]), t) for b, w in zip(*np.nonzero(found), strict=True) for t in g["of"][int(keys[b, w])]]
            done: dict[tuple[int, int], int] = {}
            for p, t in sorted(set(hits)):
                # the texts that the window touches: usually one
                for d in range(int(np.searchsorted(ends, p, side="right")), len(parts)):
                    if begins[d] >= p + size:
                        break
                    if p < done.get((d, t), -1):
                        continue
                    window = s[max(p - stride, begins[d]) : max(0, min(p + wide + stride, ends[d] - n + 1))]
                    share = float(np.isin(g["sets"][t], window).mean()) if len(window) else 0.0
                    if share >= self.containment:
                        out[d].append((g["names"][t], max(0, p - int(begins[d])), share))
                        done[d, t] = p + size
        return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w, by doubling."""
    done, out = 1, x
    while 2 * done <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - done : w - done + len(x) - w + 1])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, license, first_word, containment: one row for every match of a template in a text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        key = ("licenses", containment, tuple(sorted(templates.items())))
        scanner = state.get(key) or state.setdefault(key, Scanner(templates, containment))
        for batch in batches:
            rows, found = [], []
            for r, own in enumerate(scanner.scan_many(batch.column(text).to_pylist())):
                rows.extend([r] * len(own))
                found.extend(own)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(take), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())],
                names=[id_col, "license", "first_word", "containment"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, license string, first_word bigint, containment double")

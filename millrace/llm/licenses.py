"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Words are runs of letters, digits and other characters beyond ASCII, in lower case. Hashes of GRAM words, of which
winnowing keeps the least of each WINDOW, index the templates: any run of GRAM + WINDOW - 1 equal words shares one. A
text's own fingerprints that the index has give places where a template would begin; near ones make one candidate, and
only its words, with a margin, are aligned within a band. The alignment's common words over the template's are its
coverage; the first and last of them give the span.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.75
SCHEMA = "doc_id long, license_id string, coverage double, matched int, words int, word_start int, word_end int, byte_start int, byte_end int"


def _creative_commons() -> dict[str, str]:
    """Short and long notices of the six licenses in each of their versions, and of the public domain dedication."""
    out = {"cc0-1.0-line": "Licensed under CC0 1.0 Universal.", "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."}
    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"cc-{kind.lower()}-{version}"
            title = "-".join(words[x] for x in kind.split("-"))
            port = {"4.0": " International", "3.0": " Unported"}.get(version, " Generic")
            out[f"{name}-short"] = f"Licensed under CC {kind} {version}."
            out[f"{name}-line"] = f"This work is licensed under a Creative Commons {title} {version}{port} License."
            if version < "4.0":  # these versions wrote two of the words in two
                spaced = title.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share-Alike").replace("NoDerivatives", "NoDerivs")
                if spaced != title:
                    out[f"{name}-line-old"] = f"This work is licensed under a Creative Commons {spaced} {version}{port} License."
    return out


def _gnu() -> dict[str, str]:
    """Lines and headers of the GNU licenses beside the GPL 3, whose notices are written out below."""
    out = {}
    for short, title, versions in (("gpl", "General Public License", ("2",)), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("agpl", "Affero General Public License", ("3",))):
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            out[f"{name}-line"] = f"This work is licensed under the GNU {title}, version {v}."
            what = "This library" if (short, v) == ("lgpl", "2.1") else "This program"
            out[f"{name}-or-later-header"] = f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
    return out


_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: Notices of well-known licenses, as their stewards ask to state them.
TEMPLATES = _creative_commons() | _gnu() | {
    "mit-warranty": _AS_IS,
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-line": "Released under the BSD License.",
    "bsd-2-clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
}
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Whole texts of short licenses, without their title and copyright lines.
TEXTS = {
    "mit-text": TEMPLATES["mit-permission"] + " " + _AS_IS,
    "bsd-2-clause-text": _BSD_START + _BSD_END,
    "bsd-3-clause-text": _BSD_START + _BSD_NAME + _BSD_END,
    "isc-text": TEMPLATES["isc-permission"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}
TEMPLATES |= TEXTS


def long_texts() -> dict[str, str]:
    """Terms of the long licenses, from the files beside this module; what follows their terms (how to apply them) is left out."""
    out = {}
    for name in ("Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"):
        text = pkgutil.get_data("millrace.llm", f"texts/{name}.txt").decode()
        for end in ("END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form"):
            text = text.split(end)[0]
        out[f"{name.lower()}-text" if "." in name else f"{name.lower()}.0-text"] = text
    return out


_BLANK = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def winnow(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words that are the least of some window (the last of equal ones), and their places."""
    m = len(words) - gram + 1
    if m < 1:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    h = np.zeros(m, K.U)
    for k in range(gram):
        h += words[k : k + m] * K.PLACE[k]
    h = K.mix(h)
    if m <= window:
        at = np.array([m - 1 - int(h[::-1].argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))
    return h[at], at


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence whose text place is within `band` of template place + shift."""
    width = 2 * band + 1
    m = len(template)
    best = np.zeros((m + 1, width + 1), np.int32)  # best[i, c]: first i words, text up to i - 1 + shift - band + c
    for i in range(1, m + 1):
        at = i - 1 + shift - band + np.arange(width)
        fits = (at >= 0) & (at < len(text))
        same = fits & (text[np.clip(at, 0, max(0, len(text) - 1))] == template[i - 1]) if len(text) else np.zeros(width, bool)
        # The row before covers one place less: its column c + 1 ends where this row's column c ends.
        above = np.append(best[i - 1, 1:], best[i - 1, -1])[:width]
        through = best[i - 1, :width] + same
        best[i, :width] = np.maximum.accumulate(np.maximum(above, through))
        best[i, width] = best[i, width - 1]
    pairs, i, c = [], m, width - 1
    while i and best[i, c]:
        at = i - 1 + shift - band + c
        if c and best[i, c - 1] == best[i, c]:
            c -= 1
        elif 0 <= at < len(text) and text[at] == template[i - 1] and best[i, c] == best[i - 1, c] + 1:
            pairs.append((i - 1, at))
            i -= 1
        else:
            i, c = i - 1, min(c + 1, width - 1)
    return pairs[::-1]


class Index:
    """Words of each template, and for sorted fingerprints the template and place of each."""

    def __init__(self, templates: dict[str, str], gram: int, window: int):
        self.names = sorted(templates)
        self.words, rows = [], []
        for t, name in enumerate(self.names):
            data = np.frombuffer(templates[name].encode(), np.uint8)
            h, _, _, _ = K.word_hashes(data, np.array([0, len(data)]), _BLANK)
            self.words.append(h)
            f, at = winnow(h, gram, window)
            rows += [(int(x), t, int(p)) for x, p in zip(f, at, strict=True)]
        rows.sort()
        #: Distinct words of all templates, and how often each template has each.
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, K.U)]))
        self.counts = [np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in self.words]
        self.keys = np.array([r[0] for r in rows], K.U)
        self.template, self.place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def candidates(self, prints: np.ndarray, at: np.ndarray, band: int) -> list[tuple[int, int]]:
        """(template, place in the text where it would begin), so that each hit is within the template's band of one: the first of the hits that are not yet is the next."""
        low, high = np.searchsorted(self.keys, prints, "left"), np.searchsorted(self.keys, prints, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        count = (high - low)[hit]
        entry = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        far = 1 << 40  # beyond the words of any text
        found = np.unique(self.template[entry] * (2 * far) + np.repeat(at[hit], count) - self.place[entry] + far)
        template, shift = found // (2 * far), found % (2 * far) - far
        bounds = np.flatnonzero(np.diff(template, prepend=-1)).tolist() + [len(found)]
        out: list[tuple[int, int]] = []
        for i, j in pairwise(bounds):
            t, shifts, k = int(template[i]), shift[i:j].tolist(), 0
            while k < len(shifts):
                out.append((t, shifts[k]))
                k = bisect_right(shifts, shifts[k] + self.band(t, band), k)
        return out

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, its length for other words."""
        at = np.searchsorted(self.vocabulary, words)
        return np.where(np.append(self.vocabulary, K.U(0))[at] == words, at, len(self.vocabulary))

    def band(self, template: int, most: int) -> int:
        """At most half a template, so that copies one after the other are candidates apart; at least a fiftieth of a long one."""
        n = len(self.words[template])
        return max(min(most, max(2, n // 2)), n // 50)


def _scan(shared, gram: int, window: int, band: int, least: float):
    def one(index: Index, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        prints, at = winnow(words, gram, window)
        found: list[tuple] = []
        places: dict[int, list[int]] = {}
        for t, shift in index.candidates(prints, at, band):
            places.setdefault(t, []).append(shift)
        numbers = index.numbers(words) if places else words
        for t, shifts in places.items():
            template, count, room = index.words[t], index.counts[t], index.band(t, band)
            n, need, s = len(template), least * len(template), np.array(shifts)
            low, high = np.clip(s - room, 0, len(words)), np.clip(s + n + room, 0, len(words))
            known = np.concatenate(([0], np.cumsum(np.append(count, 0)[numbers] > 0)))
            aligned: list[tuple[int, int]] = []
            tried = []
            # No alignment has more words than stand near and are the template's, nor more of a word than both have.
            for k in np.flatnonzero((known[high] - known[low] >= need) & (high - low >= need)).tolist():
                near = np.bincount(numbers[low[k] : high[k]], minlength=len(count) + 1)[:-1]
                tried.append((-int(np.minimum(near, count).sum()), shifts[k]))
            for most, shift in sorted(tried):
                # Places closer than this share words; of those the one that matches most is the match.
                if -most < need or any(-most < m and abs(shift - x) < n // 2 - 2 * room for m, x in aligned):
                    continue
                pairs = align(template, words, shift, room)
                if pairs and len(pairs) >= need:
                    aligned.append((len(pairs), shift))
                    found.append((-len(pairs), -len(pairs) / n, pairs[0][1], pairs[-1][1], index.names[t], n))
        taken: list[tuple[int, int]] = []
        for n, share, a, b, name, size in sorted(found):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                yield name, -share, -n, size, a, b + 1, int(starts[a]), int(ends[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, n, buf, at in K.pieces(batch.column(1)):
                h, starts, ends, first = K.word_hashes(buf, at, _BLANK)
                for d in range(n):
                    a, b = first[d], first[d + 1]
                    rows += [(ids[i + d], *r) for r in one(index, h[a:b], starts[a:b] - at[d], ends[a:b] - at[d])]
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 6]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], names)

    return K.trimmed(run)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> DataFrame:
    """A row for each template found in a document: coverage (matched words over the template's), and the span in words and UTF-8 bytes, ends not included.

    Spans do not overlap: of overlapping ones that of most matched words stays, then of greater coverage, then the first,
    then by name. Null and empty texts match nothing. Repeated rows are reported each on their own,
    and a null id stays null. Words that stand between those of a template shift what follows; the shifts of one match may
    not differ by more than `band` words or a fiftieth of the template, and half a short one. Of places of one template that
    share half of it, only that of most matched words counts. Only doc_id and text are read. The templates are few and go to every worker. An empty table,
    or no templates, gives an empty result.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES | long_texts() if templates is None else templates, gram, window))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(index, gram, window, band, coverage), SCHEMA)

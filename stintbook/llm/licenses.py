"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks of a text are its lines and, for each template, overlapping windows of its words: twice as
many as the template has, a new one every half template. So a notice that is wrapped over lines at
any place lies in a window, whatever its length, and so does one with up to half as many other
words between its own. A template matches a block when at least ``THRESHOLD`` of the template's
distinct words stand in it, in any order.

Template words are ordered by their frequency over all lines of the corpus, rarest first. A block
that meets the threshold holds one of the first few words of that order (prefix filter), is at
least as large as the needed overlap (length filter), and after each word the words left must still
suffice (positional filter). So only blocks with a rare template word are looked at, and none that
meets the threshold is missed.

Besides, fixed phrases are found wherever their words stand side by side.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintbook.llm.units import stretches

THRESHOLD = 0.9
# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as licenses are commonly named in texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "GNU Lesser General Public License",
    "cc-by-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification",
    "all-rights-reserved": "Copyright All rights reserved",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided as-is, without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1.
The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.
If not, see http://www.gnu.org/licenses/""",
}

# Words after A-Z are lower case: digits, a-z, and everything beyond ASCII, as UTF-8 bytes.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Templates:
    """Templates with their words in the given order of frequency."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int]) -> None:
        said = {k: words_of(t) for k, t in templates.items()}
        self.words = {k: set(w) for k, w in said.items()}
        self.order = sorted(
            {w for s in self.words.values() for w in s}, key=lambda w: (frequency.get(w, 0), w)
        )
        self._place = {w: i for i, w in enumerate(self.order)}
        self.vocabulary = frozenset(self.order)
        self._prefix: dict[bytes, list[str]] = {}
        self._sorted, self._need, self._steps = {}, {}, {}
        for name, words in self.words.items():
            own = sorted(words, key=self._place.__getitem__)
            need = math.ceil(THRESHOLD * len(own) - 1e-9)
            self._sorted[name], self._need[name] = own, need
            self._steps[name] = window_of(len(said[name]))
            for word in own[: len(own) - need + 1]:
                self._prefix.setdefault(word, []).append(name)
        self.prefix = frozenset(self._prefix)

    def matches(self, block: set[bytes]) -> dict[str, float]:
        """Names and containments of the templates that the block meets."""
        out = {}
        seen = block & self.prefix
        for name in {n for w in seen for n in self._prefix[w]}:
            share = self.share(name, block)
            if share:
                out[name] = share
        return out

    def share(self, name: str, block: set[bytes]) -> float:
        """The containment of a template in a block, 0 below the threshold."""
        own, need = self._sorted[name], self._need[name]
        if len(block) < need:
            return 0.0
        found = 0
        for i, word in enumerate(own):
            if found + len(own) - i < need:
                return 0.0
            found += word in block
        return found / len(own) if found >= need else 0.0

    def windows(self, words: list[bytes]) -> Iterator[tuple[str, int, float]]:
        """Template, first word and containment of the windows that meet their template."""
        everything = set(words)
        names = {n for w in everything & self.prefix for n in self._prefix[w]}
        # A window has no word that the text has not.
        open_ = {n for n in names if self.share(n, everything)}
        if not open_:
            return
        starts: dict[str, set[int]] = {n: set() for n in open_}
        for at, word in enumerate(words):
            for name in self._prefix.get(word, ()):
                if name in open_:
                    size, step = self._steps[name]
                    first = max(0, at - size + step) // step
                    starts[name].update(range(first * step, at + 1, step))
        for name in sorted(open_):
            size = self._steps[name][0]
            for a in sorted(starts[name]):
                share = self.share(name, set(words[a : a + size]))
                if share:
                    yield name, a, share


def window_of(words: int) -> tuple[int, int]:
    """Words in a window for a template of so many words, and from one window to the next."""
    return 2 * words, (words + 1) // 2


def _frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many blocks of the whole corpus each template word stands. As many numbers as
    templates have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for _, texts in stretches(batches):
            for text in texts:
                for line in text.encode().lower().split(b"\n"):
                    total.update(vocabulary.intersection(_WORD.findall(line)))
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(list(total), pa.binary()),
                "blocks": pa.array(list(total.values()), pa.int64()),
            }
        )

    rows = docs.select("text").mapInArrow(count, "word binary, blocks bigint")
    summed = rows.groupBy("word").agg(F.sum("blocks").alias("blocks")).collect()
    return {bytes(r.word): r.blocks for r in summed}


_PHRASES = {tuple(p.encode().split()): label for p, label in PHRASES.items()}
# A text without any of these has none of the phrases.
_HINTS = [max(p, key=len) for p in _PHRASES]


def _places(raw: bytes, words: list[bytes]) -> list[tuple[int, str]]:
    """Word numbers where a phrase begins, with its label."""
    if not any(h in raw for h in _HINTS):
        return []
    out = []
    for phrase, label in _PHRASES.items():
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the largest containment of a matching template, else 0), n_lines and n_windows (of them
    that match a template; a window counts for each template it is cut for).

    Null text counts as empty; texts without a phrase have null places and empty labels; repeated
    rows are scanned each; other columns are left out; an empty table gives an empty result.
    """
    vocabulary = Templates(templates, {}).vocabulary
    known = Templates(templates, _frequency(docs, vocabulary))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches):
            out = [_scan(text, known) for text in texts]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                names=["doc_id", *names],
            )

    names = [
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        "n_lines", "n_windows",
    ]
    long, text, real = pa.int64(), pa.string(), pa.float64()
    kinds = [long, long, long, long, text, text, real, long, long]
    sql = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        f"doc_id {sql}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, n_lines bigint, n_windows bigint",
    )


def _scan(text: str, templates: Templates) -> tuple:
    raw = text.encode().lower()
    words = _WORD.findall(raw)
    places = _places(raw, words)
    base = sorted({label for _, label in places})
    found: dict[str, float] = {}
    lines = windows = 0
    if not templates.prefix.isdisjoint(words):
        for line in raw.split(b"\n"):
            matches = templates.matches(set(_WORD.findall(line)))
            lines += bool(matches)
            for name, share in matches.items():
                found[name] = max(found.get(name, 0.0), share)
        for name, _, share in templates.windows(words):
            windows += 1
            found[name] = max(found.get(name, 0.0), share)
    starts = [at for at, _ in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(base),
        ",".join(sorted({*base, *found})),
        max(found.values(), default=0.0),
        lines,
        windows,
    )

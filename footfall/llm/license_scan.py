"""License scans by conditional compression.

A text is taken as its words, so line breaks and comment marks do not count. Candidate blocks are runs of words around
cues of licensing, long enough for a template and its allowed differences; where they meet, longer runs of at most
four times that length that overlap by half. Each block is compressed alone and with the template as raw dictionary.
Of a text, all pairs of block and template are ranked by the bytes that the dictionary saves; each one that saves any is
confirmed in that order by the exact differences in wording: a span of the block, aligned with the template by word
edit distance (bit-parallel, Myers 1999), with at most MOST_DIFFERENT of the template's words missing, replaced or
added. In short notices the license's own name and version are not among the words that may differ. A span stays
unless it overlaps one that ranked higher. One block may give several licenses. SPDX tags are read as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from importlib.resources import files

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from footfall.llm.common import rows_of


def _fsf(kind: str, version: str, noun: str = "program", start: str = "is free software: you can") -> str:
    """The header that the Free Software Foundation recommends, up to the sentence about copies."""
    return (f"This {noun} {start} redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
            f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
            f"This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
            f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")


def _cc(name: str, short: str) -> tuple[str, ...]:
    return (f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Licensed under CC {short} 4.0.")


# Short notices and headers of common licenses; whole texts lie in `license_texts`.
TEMPLATES: dict[str, str | Sequence[str]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _fsf("", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _fsf("", "3")),
    "LGPL-2.1": _fsf("Lesser ", "2.1", "library"),
    "LGPL-3.0": _fsf("Lesser ", "3"),
    "AGPL-3.0": _fsf("Affero ", "3"),
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": _cc("Attribution", "BY"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC"),
    "proprietary": "All rights reserved.",
}
_CUE = re.compile(r"licen[sc]e|copyright|rights[\W_]+reserved|redistribut|permission|creative[\W_]+commons|public[\W_]+domain", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-]\w+)*")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([\w.+:() \t-]+)", re.I)
MOST_DIFFERENT = 0.2
# Words that must be there: names in capitals and versions of notices with at most so many words, "version N" of headers.
NOTICE, HEADER = 15, 150
_NAMED, _VERSION = re.compile(r"\b(?:[A-Z]{2,}(?:-[A-Z]+)*|\d[\d.]*)(?![\w-])"), re.compile(r"\bversion (\d[\d.]*)", re.I)


def templates_of_the_package() -> dict[str, list[str]]:
    """TEMPLATES and the whole texts, by name of the license."""
    found = {n: [t] if isinstance(t, str) else list(t) for n, t in TEMPLATES.items()}
    for f in sorted(files("footfall.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        found.setdefault(f.name.removesuffix(".txt"), []).append(f.read_text(encoding="utf-8"))
    return found


def words_of(text: str) -> list[str]:
    """Words in lower case; a version's trailing .0 does not count."""
    return [re.sub(r"^(\d+)(\.0)+$", r"\1", w.lower()) for w in _WORD.findall(text)]


def _masks(words: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _ends(masks: dict[str, int], n: int, most: int, words: Sequence[str]) -> list[tuple[int, int]]:
    """(distance, end) for every end in `words` where a span is at most `most` edits away from the n template words."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, []
    for end, w in enumerate(words, 1):
        x = masks.get(w, 0) | minus
        zero = (((x & plus) + plus) ^ plus) | x
        down, up = plus & zero, minus | (full & ~(plus | zero))
        score += 1 if up & top else -1 if down & top else 0
        up = up << 1 & full
        minus, plus = up & zero, (down << 1 | ~(up | zero)) & full
        if score <= most:
            out.append((score, end))
    return out


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.n = len(self.words)
        self.most = int(MOST_DIFFERENT * self.n)
        self.masks, self.back = _masks(self.words), _masks(self.words[::-1])
        self.bag = Counter(self.words)
        named = _NAMED.findall(text) if self.n <= NOTICE else _VERSION.findall(text) if self.n <= HEADER else []
        self.named = {w for x in named for w in words_of(x)}
        self.given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
            " ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def may_be_in(self, have: Counter) -> bool:
        """False only where more words than allowed are missing in the whole text."""
        missing = 0
        for w, c in self.bag.items():
            missing += max(c - have[w], 0)
            if missing > self.most:
                return False
        return True

    def blocks(self, cues: Sequence[int], length: int) -> Iterator[tuple[int, int]]:
        """Runs of words, at most four times as long as the longest span; every span with a cue lies in one of them."""
        reach = self.n + self.most
        runs: list[list[int]] = []
        for c in cues:
            if runs and c - reach <= runs[-1][1]:
                runs[-1][1] = min(c + reach, length)
            else:
                runs.append([max(c - reach, 0), min(c + reach, length)])
        for lo, hi in runs:
            while hi - lo > 4 * reach:
                yield lo, lo + 4 * reach
                lo += 2 * reach
            yield lo, hi

    def spans(self, words: Sequence[str], lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, end, distance) of spans that do not overlap, nearest first, then leftmost."""
        chosen: list[tuple[int, int, int]] = []
        for distance, e in sorted(_ends(self.masks, self.n, self.most, words[lo:hi])):
            end = lo + e
            at = bisect_left(chosen, (end,))
            before = chosen[at - 1][1] if at else lo
            # a span with this distance has at least n - distance words
            if end - (self.n - distance) < before:
                continue
            tail = words[max(lo, end - self.n - distance):end][::-1]
            start = end - min(b for d, b in _ends(self.back, self.n, distance, tail) if d == distance)
            if start >= before:
                insort(chosen, (start, end, distance))
        return chosen

    def missing(self, words: Sequence[str]) -> int:
        """Template words outside the longest common subsequence with `words`."""
        full = rest = (1 << self.n) - 1
        for w in words:
            m = rest & self.masks.get(w, 0)
            rest = (rest + m | rest - m) & full
        return rest.bit_count()


class Scanner:
    def __init__(self, templates: Mapping[str, str | Sequence[str]]):
        self.alone = zstandard.ZstdCompressor(level=3)
        self.templates = [Template(n, t) for n, many in templates.items() for t in ([many] if isinstance(many, str) else many)]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(license, bytes saved on its block, template words missing) of every confirmed span, in the order of the text."""
        tags = [(i, 0, 0) for m in _SPDX.finditer(text) for i in self.tagged(m[1])]
        places = list(_WORD.finditer(text))
        ends = [m.end() for m in places]
        # the word that holds the first character of a cue
        cues = sorted({bisect_left(ends, m.start() + 1) for m in _CUE.finditer(text)})
        words = words_of(text)
        have = Counter(words)
        ranked = [(self.saving(t, words[lo:hi]), at, lo, hi) for at, t in enumerate(self.templates) if t.n and t.may_be_in(have)
                  for lo, hi in t.blocks(cues, len(words))]
        chosen: list[tuple] = []
        for gain, which, lo, hi in sorted((r for r in ranked if r[0] > 0), key=lambda r: (-r[0], *r[1:])):
            t = self.templates[which]
            for start, end, _ in t.spans(words, lo, hi):
                span, at = words[start:end], bisect_left(chosen, (end,))
                if t.named.issubset(span) and (not at or chosen[at - 1][1] <= start):
                    insort(chosen, (start, end, t.name, gain, t.missing(span)))
        return tags + [(name, gain, missing) for _, _, name, gain, missing in chosen]

    def saving(self, template: Template, words: Sequence[str]) -> int:
        """Bytes that the template as dictionary saves on a block."""
        raw = " ".join(words).encode()
        return len(self.alone.compress(raw)) - len(template.given.compress(raw))

    @staticmethod
    def tagged(expression: str) -> list[str]:
        """Licenses of an SPDX expression, without exceptions and operators."""
        out, before = [], ""
        for w in re.findall(r"[\w.+:-]*[\w+]", expression):
            if w.upper() in ("AND", "OR", "WITH") or before.upper() == "WITH":
                before = w
                continue
            if out and before.upper() not in ("AND", "OR"):
                break
            if w not in ("NONE", "NOASSERTION"):
                out.append(w)
            before = w
        return out


def scan(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None) -> DataFrame:
    """doc_id, n_blocks (lines in which a cue begins), n_matched (confirmed spans and SPDX licenses), licenses (distinct
    names, sorted, comma-joined), missing_words of every row.

    Null and empty texts have no blocks; repeated rows are each reported; an empty table gives no rows.
    """
    templates = templates or templates_of_the_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out: dict = {"n_blocks": [], "n_matched": [], "licenses": [], "missing_words": []}
            for text in batch["text"].to_pylist():
                cued = _CUE.search(text)
                found = scanner.find(text) if cued else []
                out["n_blocks"].append(_lines_with_cue(text) if cued else 0)
                out["n_matched"].append(len(found))
                out["licenses"].append(",".join(sorted({m[0] for m in found})))
                out["missing_words"].append(sum(m[2] for m in found))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)}})

    return rows_of(docs).mapInArrow(run, "doc_id BIGINT, n_blocks BIGINT, n_matched BIGINT, licenses STRING, missing_words BIGINT")


def _lines_with_cue(text: str) -> int:
    lines, at = 0, -1
    for m in _CUE.finditer(text):
        if at < 0 or text.find("\n", at, m.start()) >= 0:
            lines += 1
        at = m.start()
    return lines

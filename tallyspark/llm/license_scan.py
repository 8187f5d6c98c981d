"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template of m five-word shingles is sought in windows of 1.25 m shingles, each starting 0.25 m after the last, so that
every run of m shingles lies in a window. A window that holds at least 0.8 m of them has a Jaccard similarity of 0.55 or
more with the template; 32 bands of two MinHash rows then collide with a probability above 0.9999. A window without any
shingle of a template can't collide, so signatures are computed only for windows that hold one; this changes no result.
What the bands retrieve is verified by counting the template's distinct shingles in the window.

Notices under five words are one shingle of their whole sequence. A window of one shingle has the signature of the notice
exactly when it holds it, so bands and containment come down to equal shingle numbers, and those are compared.

A scan is one pass over the texts without a shuffle. The templates are parameters and travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import mix64

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
ROWS = 2
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
#: ASCII letters and digits make words, A-Z lower-cased; other ASCII separates them; bytes of other characters are letters.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Template(NamedTuple):
    name: str
    text: str


_GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by "
        "the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. {1}Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. ")
_BSD_NAMES = ("{0}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED.")

#: Notices as their licenses word them, and the one-line forms in common use.
TEMPLATES = (
    Template("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    Template("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    Template("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    Template("MIT-line", "Released under the MIT License."),
    Template("MIT-line", "Licensed under the MIT License."),
    Template("MIT-line", "Distributed under the MIT License."),
    Template("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    Template("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-ND-4.0-line", "Licensed under CC BY-ND 4.0."),
    Template("CC-BY-NC-SA-4.0-line", "Licensed under CC BY-NC-SA 4.0."),
    Template("CC-BY-NC-ND-4.0-line", "Licensed under CC BY-NC-ND 4.0."),
    *(Template(f"{name}-line", f"SPDX-License-Identifier: {name}") for name in (
        "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0",
        "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")),
    Template("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.")),
    Template("AGPL-3.0", _GNU.format("program", ":", "Affero General Public License", ",", 3)),
    Template("BSD-2-Clause", _BSD.format("", "") + _BSD_END),
    Template("BSD-2-Clause", _BSD.format("1. ", "2. ") + _BSD_END),
    Template("BSD-3-Clause", _BSD.format("", "") + _BSD_NAMES.format("") + _BSD_END),
    Template("BSD-3-Clause", _BSD.format("1. ", "2. ") + _BSD_NAMES.format("3. ") + _BSD_END),
    Template("GPL-2.0", _GNU.format("program", ";", "General Public License", ";", 2)),
    Template("GPL-3.0", _GNU.format("program", ":", "General Public License", ",", 3)),
    Template("LGPL-2.1", _GNU.format("library", ";", "Lesser General Public License", ";", 2.1)),
    Template("LGPL-3.0", _GNU.format("program", ":", "Lesser General Public License", ",", 3)),
    Template("LGPL-3.0", _GNU.format("library", ":", "Lesser General Public License", ",", 3)),
    Template("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.")),
    Template("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:")),
    Template("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")),
)


#: Notices under ``SHINGLE`` words.
NOTICES = (
    Template("All-rights-reserved", "All rights reserved."),
    Template("ISC-line", "SPDX-License-Identifier: ISC"),
    Template("MIT-line", "SPDX-License-Identifier: MIT"),
)


class Match(NamedTuple):
    """``license`` in the words ``first_word`` to ``last_word`` (from 0), with the share of its shingles found there."""

    license: str
    containment: float
    first_word: int
    last_word: int


def text_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def fullest(matches: Column) -> Column:
    """The matches without those that one of another license overlaps, as long and with more of its shingles.

    Licenses that differ in a few words (GPL, LGPL and AGPL, or the BSD forms) match each other's texts in part.
    """
    def beats(o: Column, m: Column) -> Column:
        return ((o["license"] != m["license"]) & (o["containment"] > m["containment"])
                & (o["first_word"] <= m["last_word"]) & (m["first_word"] <= o["last_word"])
                & (o["last_word"] - o["first_word"] >= m["last_word"] - m["first_word"]))

    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: beats(o, m)))


class Scanner:
    """The templates' shingles, exact as numbers over the templates' own vocabulary, and their band keys."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT,
                 notices: Sequence[Template] = NOTICES):
        self.templates, self.containment, self.notices = list(templates), containment, list(notices)
        self.vocabulary: dict[bytes, int] = {}
        for template in [*templates, *notices]:
            for word in text_words(template.text):
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        if self.base ** SHINGLE >= 1 << 63:
            raise ValueError("the templates have too many different words")
        self.shingles, self.bands = [], []
        for template in templates:
            words = text_words(template.text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {template.name} has fewer than {SHINGLE} words; it can be a notice")
            self.shingles.append(np.unique(self._numbers(self._ids(words), SHINGLE)))
            self.bands.append(_band_keys(_signature(np.unique(_hashes(words)))))
        self.known = np.unique(np.concatenate(self.shingles)) if templates else np.empty(0, dtype=np.int64)
        self.short: dict[int, list[tuple[str, int]]] = {}
        for notice in notices:
            words = text_words(notice.text)
            if not 0 < len(words) < SHINGLE:
                raise ValueError(f"notice {notice.name} has no word, or {SHINGLE} and more: it is a template then")
            self.short.setdefault(len(words), []).append((notice.name, int(self._numbers(self._ids(words), len(words))[0])))

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def _numbers(self, ids: np.ndarray, length: int) -> np.ndarray:
        """A number per shingle of ``length`` words, 0 if a word is in no template or notice."""
        n = len(ids) - length + 1
        if n < 1:
            return np.empty(0, dtype=np.int64)
        numbers, whole = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(length):
            part = ids[k:k + n]
            numbers = numbers * self.base + part
            whole &= part > 0
        return np.where(whole, numbers, 0)

    def window(self, template: int) -> tuple[int, int]:
        """Length and stride of the windows for a template, in shingles."""
        m = len(self.shingles[template])
        length = -(-5 * m // 4)
        return length, max(1, length - m)

    def scan(self, text: str | None) -> list[Match]:
        """Matches of the templates."""
        words = text_words(text)
        return self._scan(words, self._ids(words))

    def scan_all(self, text: str | None) -> tuple[list[Match], list[Match]]:
        """Matches of the templates, and those of the notices."""
        words = text_words(text)
        ids = self._ids(words)
        return self._scan(words, ids), self._scan_short(ids)

    def _scan_short(self, ids: np.ndarray) -> list[Match]:
        found: list[Match] = []
        for length, notices in self.short.items():
            numbers = self._numbers(ids, length)
            for name, number in notices:
                starts = np.flatnonzero(numbers == number).tolist()
                found += _merge([Match(name, 1.0, start, start + length - 1) for start in starts])
        return sorted(found, key=lambda m: (m.first_word, m.license))

    def _scan(self, words: list[bytes], ids: np.ndarray) -> list[Match]:
        numbers = self._numbers(ids, SHINGLE)
        at = np.searchsorted(self.known, numbers)
        hits = np.flatnonzero((numbers > 0) & (self.known[np.minimum(at, len(self.known) - 1)] == numbers)) if len(
            self.known) else np.empty(0, dtype=np.int64)
        if not len(hits):
            return []
        hashes = _hashes(words)
        found: list[Match] = []
        signatures: dict[tuple[int, int], np.ndarray] = {}
        for t in range(len(self.templates)):
            length, stride = self.window(t)
            verified = []
            for start in _window_starts(hits, length, stride, len(numbers)):
                keys = signatures.get((start, length))
                if keys is None:
                    keys = signatures[start, length] = _band_keys(_signature(np.unique(hashes[start:start + length])))
                if (keys == self.bands[t]).any():
                    match = self._verify(t, numbers, start, length)
                    if match is not None:
                        verified.append(match)
            found += _merge(verified)
        return sorted(found, key=lambda m: (m.first_word, m.license))

    def _verify(self, t: int, numbers: np.ndarray, start: int, length: int) -> Match | None:
        inside = np.flatnonzero(np.isin(numbers[start:start + length], self.shingles[t]))
        share = len(np.unique(numbers[start + inside])) / len(self.shingles[t])
        if share < self.containment:
            return None
        return Match(self.templates[t].name, share, int(start + inside[0]), int(start + inside[-1] + SHINGLE - 1))


def _window_starts(hits: np.ndarray, length: int, stride: int, n: int) -> list[int]:
    """Starts, multiples of ``stride``, of the windows that hold a hit."""
    first = np.maximum(0, -(-(hits - length + 1) // stride))
    last = hits // stride
    steps = np.arange(-(-length // stride) + 1)
    starts = first[:, None] + steps[None]
    return (np.unique(starts[starts <= last[:, None]]) * stride).tolist()


def _merge(verified: list[Match]) -> list[Match]:
    """Overlapping matches are one, the fullest; among equals the first."""
    merged: list[Match] = []
    for match in verified:
        if merged and match.first_word <= merged[-1].last_word:
            if match.containment > merged[-1].containment:
                merged[-1] = match
        else:
            merged.append(match)
    return merged


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per shingle."""
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    n = max(0, len(words) - SHINGLE + 1)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        hashes = mix64(hashes + each[k:k + n])
    return hashes


def _signature(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[None, :] ^ _SEEDS[:, None]).min(axis=1)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys + rows[:, r])
    return keys


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT,
         id_col: str = "doc_id", text_col: str = "text", notices: Sequence[Template] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, and by position ``matches`` of templates and ``short_matches`` of notices.

    Both hold license, containment, first_word and last_word. ``templates`` have at least ``SHINGLE`` words, ``notices``
    fewer. Overlapping matches of one template are one; different templates may overlap. A null or empty text has none.
    Ids may be null or repeated; an empty table gives no rows. Other columns aren't read.
    """
    scanner = Scanner(templates, containment, notices=notices)
    found = "array<struct<license string, containment double, first_word long, last_word long>>"

    @F.pandas_udf(f"matches {found}, short_matches {found}")
    def matches(texts: pd.Series) -> pd.DataFrame:
        rows = [[[m._asdict() for m in part] for part in scanner.scan_all(t)] for t in texts]
        return pd.DataFrame({"matches": pd.Series([r[0] for r in rows], dtype=object),
                             "short_matches": pd.Series([r[1] for r in rows], dtype=object)})

    return (docs.select(F.col(f"`{id_col}`").alias(id_col), matches(F.col(f"`{text_col}`")).alias("_found"))
            .select(F.col(f"`{id_col}`"), "_found.matches", "_found.short_matches"))

"""Operator 5: licence scans by the Dice coefficient over word bigrams.

A text is normalised to words; a stretch of it is compared with a template by 2 |A and B| / (|A| + |B|) over their sets of word
bigrams. A stretch can reach the threshold only if it holds enough of a template's bigrams, which prunes the templates, and not too
many others, which bounds its size. Of the rest every stretch is scored that can't be shortened without losing one of those bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adtflow.llm.jaccard import word_hashes
from adtflow.llm.shared import map_arrow

#: Dice coefficient from which a stretch counts as a template.
THRESHOLD = 0.8

# Licences by SPDX identifier and the names that notices call them by.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "the MIT license", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPL version 2", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPL version 3", "GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPL 2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL 3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPLv3"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "MPL 2.0"),
    "ISC": ("the ISC License",),
    "EPL-2.0": ("the Eclipse Public License, Version 2.0",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
FORMS = ("licensed under {}", "released under {}", "distributed under {}", "this work is licensed under {}", "this project is licensed under the terms of {}", "available under {}")
# Standard permission notices.
NOTICES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means.""",
}
#: Punctuation separates words; other bytes are parts of words.
_SEPARATORS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def templates() -> list[tuple[str, str]]:
    """Licence and text of every template."""
    notices = [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS]
    return notices + [(k, f"SPDX-License-Identifier: {k}") for k in NAMES] + list(NOTICES.items())


def bigrams(text: str | None) -> np.ndarray:
    """A hash for each pair of neighbouring words, in order."""
    w = word_hashes((text or "").encode("utf-8", "replace").translate(_SEPARATORS).decode("utf-8"))
    if len(w) < 2:
        return np.empty(0, np.int64)
    h = (w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ w[1:]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Match:
    license: str
    first_word: int
    n_words: int
    score: float


class Scanner:
    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.licenses, self.sets, self.lengths = [], [], []
        for name, text in templates():
            b = bigrams(text)
            self.licenses.append(name)
            self.sets.append(set(b.tolist()))
            self.lengths.append(len(b))
        self.known = np.unique(np.concatenate([np.fromiter(s, np.int64) for s in self.sets]))
        #: by known bigram and template: whether the template has it
        self.has = np.zeros((len(self.known), len(self.sets)), bool)
        for t, s in enumerate(self.sets):
            self.has[np.searchsorted(self.known, np.fromiter(s, np.int64)), t] = True
        sizes = np.array([len(s) for s in self.sets])
        # of two sets a and b with 2 |A and B| >= threshold (|A| + |B|): the least overlap, and the most that |A| can be
        self.least = np.ceil(threshold / (2 - threshold) * sizes - 1e-9).astype(int)
        self.most = np.floor((2 - threshold) / threshold * sizes + 1e-9).astype(int)

    def scan(self, text: str | None) -> list[Match]:
        """The best non-overlapping stretches of a text, best first where they compete, in order of place."""
        b = bigrams(text)
        at = np.minimum(np.searchsorted(self.known, b), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == b)
        if not len(hits):
            return []
        kinds = at[hits]
        some = np.flatnonzero(self.has[np.unique(kinds)].sum(axis=0) >= self.least)
        if not len(some):
            return []
        # where each bigram was last before, to count distinct ones from any place on
        order = np.argsort(b, kind="stable")
        before = np.full(len(b), -1)
        same = b[order[1:]] == b[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        found = []
        for t in some.tolist():
            mine = self.has[kinds, t]
            for s, first, m in self._stretches(hits[mine], kinds[mine], before, t):
                found.append((-round(s, 6), -self.lengths[t], first, m, t))
        out: list[Match] = []
        for s, _, first, m, t in sorted(found):
            if not any(first < x.first_word + x.n_words and x.first_word < first + m + 1 for x in out):
                out.append(Match(self.licenses[t], first, m + 1, -s))
        return sorted(out, key=lambda x: x.first_word)

    def _stretches(self, places: np.ndarray, kinds: np.ndarray, before: np.ndarray, t: int) -> Iterator[tuple[float, int, int]]:
        """Score, first bigram and number of bigrams of the stretches that match template t and hold their first and last bigram once.

        Of stretches with one start a longer one is left out unless it scores more: the shorter, which comes first, overlaps it.
        places, kinds: of the template's bigrams in the text.
        """
        size, least, most = len(self.sets[t]), int(self.least[t]), int(self.most[t])
        upcoming: dict[int, int] = {}  # the next place of each of the template's bigrams, nearest first
        for p, kind in zip(places[::-1].tolist(), kinds[::-1].tolist(), strict=True):
            again = upcoming.pop(kind, len(before))
            upcoming = {kind: p, **upcoming}
            ends = [e for e in upcoming.values() if e < again]
            if len(ends) < least:
                continue
            # places up to the first that is one distinct bigram too many; most stretches are short, so few are looked at in vain
            distinct, width = np.empty(0, int), 2 * most
            while True:
                stop = min(p + width, ends[-1] + 1)
                distinct = np.cumsum(before[p:stop] < p)
                if stop > ends[-1] or distinct[-1] > most:
                    break
                width *= 2
            top = 0.0
            for shared, e in enumerate(ends, 1):
                if e >= stop or distinct[e - p] > most:
                    break
                s = 2 * shared / (int(distinct[e - p]) + size)
                if s >= self.threshold and s > top:
                    top = s
                    yield s, p, e - p + 1


@lru_cache(2)
def scanner(threshold: float = THRESHOLD) -> Scanner:
    return Scanner(threshold)


def license_matches(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, first_word, n_words and dice of each stretch of a text that matches a template.

    Texts without a match, empty and null texts give no rows; repeated rows give repeated rows; other columns are not read. Of
    templates that match overlapping stretches the best stays; ties go to the longer template, then to the earlier place. A stretch
    begins and ends with a bigram of its template that it holds once.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner(threshold)
        rows = [(i, m.license, m.first_word, m.n_words, m.score) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in s.scan(t)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "license", "first_word", "n_words", "dice"])

    slim = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, license string, first_word long, n_words long, dice double")

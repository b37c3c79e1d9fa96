"""License scans: MinHash bands over overlapping windows retrieve templates,
exact shingle containment verifies them.

Templates are grouped by their number of words.  For every group, windows of
that many words slide over the whole text; a window's MinHash bands are looked
up among those of the group's templates.  The number of bands is chosen so that
a window holding a template with the least containment collides with it with
at least the wanted probability.  A retrieved template is then compared with
the words around the window, shingle by shingle; its numbers (versions) must all
stand in the match.  Of matches that overlap, the best contained one is marked.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, shingle_hashes, slices, word_hashes, word_spans

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
#: Templates per pass over the documents; more are scanned in further passes,
#: so what a task holds of them is bounded.
TEMPLATES_PER_PASS = 4096

# Wordings of well-known notices and of license headers.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the "
                 "GNU Lesser General Public License as published by the Free Software Foundation; either version "
                 "2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU Affero General Public License as published by the Free Software Foundation, either version "
                 "3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
                "of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission."),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
                     "License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
]

#: A-Z to lower case, other ASCII characters that are no letter or digit to spaces.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def bands(jaccard: float, miss: float = MISS) -> int:
    """Bands of one MinHash each after which a pair of at least this Jaccard
    similarity is missed with probability ``miss`` at most."""
    return max(1, ceil(log(miss) / log(1 - jaccard))) if jaccard < 1 else 1


def least_jaccard(n: int, stride: int) -> float:
    """Of a template of n shingles and the window that lies best over a copy
    with the least containment, the stride costing up to half a step."""
    shared = max(1.0, CONTAINMENT * n - stride / 2)
    return shared / (2 * n - shared)


def numbers(words: list[bytes]) -> set[bytes]:
    """The words with a digit: a match must have those of its template."""
    return {w for w in words if any(48 <= c <= 57 for c in w)}


def best_of(matches: list[tuple[int, int, int, float]]) -> list[bool]:
    """Which of a text's matches (template, first word, words, containment) no
    better one overlaps: the best contained first, then the longest, then the
    first template."""
    order = sorted(range(len(matches)), key=lambda m: (-matches[m][3], -matches[m][2], matches[m][0], matches[m][1]))
    taken = np.zeros(max((a + n for _, a, n, _ in matches), default=0), dtype=bool)
    out = [False] * len(matches)
    for m in order:
        _, a, n, _ = matches[m]
        if not taken[a:a + n].any():
            out[m] = True
            taken[a:a + n] = True
    return out


class Scanner:
    """Bands of one block of templates, and the scan of a batch of texts."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(i, name, words_of(text)) for i, (name, text) in templates]
        self.sets = {i: shingles(w) for i, _, w in self.templates}
        self.numbers = {i: numbers(w) for i, _, w in self.templates}
        self.sizes = {i: len(w) for i, _, w in self.templates}
        self.groups = []
        by_words: dict[int, list] = {}
        for t in self.templates:
            if t[2]:
                by_words.setdefault(len(t[2]), []).append(t)
        for size, group in sorted(by_words.items()):
            k = min(SHINGLE, size)
            n = size - k + 1
            stride = max(1, n // 8)
            b = bands(least_jaccard(n, stride))
            keys: list[dict[int, list[int]]] = [{} for _ in range(b)]
            for i, _, words in group:
                raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
                h = shingle_hashes(word_hashes(raw, *word_spans(raw)), k)
                for j in range(b):
                    keys[j].setdefault(int(self._hashed(h, j).min()), []).append(i)
            tables = []
            for found in keys:
                table = np.zeros(1 << 16, dtype=bool)
                table[[x >> 48 for x in found]] = True
                tables.append(table)
            self.groups.append((size, k, n, stride, keys, tables))
        self.longest = max(by_words, default=0)

    @staticmethod
    def _hashed(h: np.ndarray, j: int) -> np.ndarray:
        """Hash function j of the shingles, uniform over 64 bits."""
        odd = np.uint64((0xA0761D6478BD642F + 0x9E3779B97F4A7C16 * j) % 2**64 | 1)
        with np.errstate(over="ignore"):
            x = h * odd
            return x ^ (x >> np.uint64(32))

    @staticmethod
    def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
        """Minimum of every n neighbours, by doubling."""
        out, have = x, 1
        while have < n:
            step = min(have, n - have)
            out = np.minimum(out[:len(out) - step], out[step:])
            have += step
        return out

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, words, containment) of every match."""
        folded = [t.encode().translate(FOLD) for t in texts]
        # A control character parts the texts and fills up the last window.
        raw = np.frombuffer(b" \x01 ".join(folded) + b" \x01" * (self.longest + 1), dtype=np.uint8)
        start, end = word_spans(raw)
        h = word_hashes(raw, start, end)
        if not len(h):
            return []
        offset = np.concatenate(([0], np.cumsum([len(x) + 3 for x in folded])))
        hits: dict[tuple[int, int], set[int]] = {}
        by_k: dict[int, np.ndarray] = {}
        for size, k, n, stride, keys, tables in self.groups:
            if k not in by_k:
                by_k[k] = shingle_hashes(h, k)
            s = by_k[k]
            for j, (known, table) in enumerate(zip(keys, tables, strict=True)):
                low = self._sliding_min(self._hashed(s, j), n)[::stride]
                near = np.flatnonzero(table[low >> np.uint64(48)])
                for at in near.tolist():
                    for i in known.get(int(low[at]), ()):
                        first = at * stride
                        text = int(np.searchsorted(offset, start[first], "right")) - 1
                        hits.setdefault((text, i), set()).add(first)
        out = []
        firsts = np.searchsorted(start, offset)
        for (text, i), found in sorted(hits.items()):
            words = folded[text].split()
            out += [(text, i, *m) for m in self._matches(words, i, sorted(
                x - int(firsts[text]) for x in found))]
        return out

    def _matches(self, words: list[bytes], i: int, found: list[int]):
        """The verified matches of template i near the windows ``found``."""
        wanted = self.sets[i]
        size = self.sizes[i]
        k = min(SHINGLE, size)
        # Runs of overlapping windows are one stretch of text.
        runs: list[list[int]] = []
        for x in found:
            if runs and x <= runs[-1][1]:
                runs[-1][1] = x + 2 * size
            else:
                runs.append([max(0, x - size), x + 2 * size])
        for a, b in runs:
            region = words[a:b]
            inside = [tuple(region[p:p + k]) in wanted for p in range(len(region) - k + 1)]
            p = 0
            while p < len(inside):
                if inside[p]:
                    here = {tuple(region[q:q + k]) for q in range(p, min(p + size - k + 1 + size // 5, len(inside)))}
                    share = len(here & wanted) / len(wanted)
                    last = max(q for q in range(p, min(p + size - k + 1 + size // 5, len(inside))) if inside[q])
                    if share >= CONTAINMENT and self.numbers[i] <= set(region[p:last + k]):
                        yield a + p, last - p + k, share
                        p = last + k
                        continue
                p += 1


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, template_id, license, start_word, n_words, containment, best: one row
    per match of a template (license, text) in a row of ``docs``.  ``best``: no match
    of its block of templates that overlaps it is better contained, longer, or of
    an earlier template.

    Words are compared in lower case without ASCII punctuation; ``start_word``
    counts such words.  A template of under five words is one shingle.  NULL,
    empty and wordless texts match nothing, nor do templates without words;
    rows that repeat match each on its own; whole texts are scanned.
    """
    listed = list(enumerate(NOTICES if templates is None else templates))
    names = {i: name for i, (name, _) in listed}
    rows = pick(docs, "doc_id", "text")

    def one_pass(block):
        def run(batches):
            from .licenses import Scanner

            scanner = Scanner(block)
            for batch in batches:
                for part in slices(batch, 256):
                    ids = part.column("doc_id").to_pylist()
                    found = scanner.scan([x or "" for x in part.column("text").to_pylist()])
                    if found:
                        text, i, at, n, share = zip(*found, strict=True)
                        edge = [0, *[x for x in range(1, len(text)) if text[x] != text[x - 1]], len(text)]
                        best = [y for a, b in zip(edge, edge[1:]) for y in best_of([m[1:] for m in found[a:b]])]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([ids[x] for x in text], pa.int64()),
                            "template_id": pa.array(i, pa.int32()),
                            "license": pa.array([names[x] for x in i], pa.string()),
                            "start_word": pa.array(at, pa.int64()), "n_words": pa.array(n, pa.int64()),
                            "containment": pa.array(share, pa.float64()), "best": pa.array(best, pa.bool_())})

        return rows.mapInArrow(run, "doc_id long, template_id int, license string, start_word long, "
                                    "n_words long, containment double, best boolean")

    out = None
    for i in range(0, max(1, len(listed)), TEMPLATES_PER_PASS):
        part = one_pass(listed[i:i + TEMPLATES_PER_PASS])
        out = part if out is None else out.unionByName(part)
    return out



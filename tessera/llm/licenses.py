"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are sequences of lower-case words without punctuation, and of their five-word shingles. Windows
are two neighbouring blocks of BLOCK shingles, one block apart, so windows overlap by half and every run of up to
BLOCK + 1 shingles lies within one. Templates are cut into pieces of that size. A piece of one shingle in a full window
has similarity 1 / (2 BLOCK); with BANDS bands of one row each, it collides in some band with probability
1 - (1 - 1 / 8) ** 60 = 0.9997, and longer pieces more surely. A collision proposes the piece's template near the window.

Templates of fewer than five words are one shingle of their whole length. Windows don't retrieve them: each run of as
many words in the text is looked up by its hash.

A template matches where a run of ``ceil(1.25 t)`` shingles holds at least 80 % of its t distinct shingles; this is
checked on the words themselves, around each proposal.

Defined cases: null and empty texts match nothing, and those of fewer than five words only shorter templates; repeated
rows and null ids are rows of their own; templates without words are refused; an empty table gives an empty result; other columns
are ignored. The whole text is scanned; memory holds the shingle hashes of a few MB of text.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty
from tessera.llm.license_texts import TEXTS

SHINGLE = 5
LEAST = 0.8
BLOCK = 4
BANDS = 60
WORD = re.compile(r"[^\W_]+(?:[-.'][^\W_]+)*")

# Notices of common public licenses, with their SPDX names.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

# Notices of fewer than SHINGLE words, which are found only whole. Those of SPDX are the lines "SPDX-License-Identifier: name".
SHORT_TEMPLATES = (
    ("All-rights-reserved", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0",
    )),
)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str]) -> list[tuple[str, ...]]:
    return [tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1)]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        data = word.encode("utf-8", "surrogatepass")
        self[word] = found = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return found


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one sequence of word hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return out ^ out >> np.uint64(29)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least, self.hashes, self.templates = least, WordHashes(), []
        rng = np.random.default_rng(17)
        self.a = rng.integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, BANDS, np.uint64)
        self.table: list[dict[int, set[int]]] = [defaultdict(set) for _ in range(BANDS)]
        self.maybe = np.zeros((BANDS, 1 << 16), bool)
        self.short: dict[int, dict[int, list[tuple[str, list[str]]]]] = {}  # by number of words and hash
        for name, text in templates:
            tokens = words(text)
            if not tokens:
                raise ValueError(f"the template {text!r} has no words")
            if len(tokens) < SHINGLE:
                whole = int(shingle_hashes(np.array([self.hashes[w] for w in tokens], np.uint64), len(tokens))[0])
                self.short.setdefault(len(tokens), {}).setdefault(whole, []).append((name, tokens))
                continue
            k = len(self.templates)
            self.templates.append((name, frozenset(shingles(tokens))))
            every = shingle_hashes(np.array([self.hashes[w] for w in tokens], np.uint64))
            for piece in np.array_split(every, -(-len(every) // (BLOCK + 1))):
                for i in range(BANDS):
                    least_hash = int(((piece * self.a[i] + self.b[i]) >> np.uint64(32)).min())
                    self.table[i][least_hash].add(k)
                    self.maybe[i, least_hash >> 16] = True

    def proposals(self, blocks: np.ndarray) -> set[tuple[int, int]]:
        """(block, template) where a window that begins at the block collides with a piece, for blocks x BLOCK hashes."""
        found = set()
        for at in range(0, len(blocks), 8192):
            columns = np.ascontiguousarray(blocks[at : at + 8193].T)
            for i in range(BANDS):
                low = (columns[0] * self.a[i] + self.b[i]) >> np.uint64(32)
                for column in columns[1:]:
                    low = np.minimum(low, (column * self.a[i] + self.b[i]) >> np.uint64(32))
                low[:-1] = np.minimum(low[:-1], low[1:])
                for j in np.flatnonzero(self.maybe[i, low >> np.uint64(16)]):
                    found.update((at + int(j), k) for k in self.table[i].get(int(low[j]), ()))
        return found

    def best(self, tokens: list[str], template: int, around: int) -> float:
        """The largest containment of the template in runs of shingles near the window at shingle ``around``."""
        wanted = self.templates[template][1]
        span = -(-5 * len(wanted) // 4)
        first = max(0, around - len(wanted) - span)
        held: dict[tuple[str, ...], int] = defaultdict(int)
        near, best = shingles(tokens[first : around + 2 * BLOCK + len(wanted) + span + SHINGLE]), 0
        for i, s in enumerate(near):
            if s in wanted:
                held[s] += 1
            if i >= span and (gone := near[i - span]) in wanted:
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            best = max(best, len(held))
        return best / len(wanted)

    def whole(self, tokens: list[str], hashes: np.ndarray, found: dict[str, float]) -> None:
        """Adds the short templates that a text holds."""
        for size, known in self.short.items():
            every = shingle_hashes(hashes, size)
            for whole, templates in known.items():
                for i in np.flatnonzero(every == np.uint64(whole)).tolist():
                    found.update((name, 1.0) for name, wanted in templates if tokens[i : i + size] == wanted)

    def scan(self, texts: list[list[str]]) -> list[dict[str, float]]:
        """The largest containment of each matching template's license, for each text."""
        parts, starts, total = [], [], 0
        out: list[dict[str, float]] = [{} for _ in texts]
        for tokens, found in zip(texts, out, strict=True):
            starts.append(total)
            hashes = np.fromiter(map(self.hashes.__getitem__, tokens), np.uint64, len(tokens))
            self.whole(tokens, hashes, found)
            every = shingle_hashes(hashes)
            if len(every):
                fill = -len(every) % BLOCK + BLOCK  # the last shingle once more, up to a whole block and one beyond
                parts.append(np.concatenate([every, np.full(fill, every[-1])]).reshape(-1, BLOCK))
                total += len(parts[-1])
        if not parts:
            return out
        seen: dict[int, int] = {}  # by template, the last block that was looked around
        for block, template in sorted(self.proposals(np.concatenate(parts))):
            k = int(np.searchsorted(starts, block, "right")) - 1
            before = seen.get(template, -1)
            if before >= starts[k] and (block - before) * BLOCK <= len(self.templates[template][1]):
                continue  # every run that meets this window was looked at from there
            seen[template] = block
            contained = self.best(texts[k], template, (block - starts[k]) * BLOCK)
            name = self.templates[template][0]
            if contained >= self.least and contained > out[k].get(name, 0):
                out[k][name] = contained
        return out


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + SHORT_TEMPLATES + TEXTS, least: float = LEAST) -> DataFrame:
    """(doc_id, licenses, containment) per row: the sorted names of the matching licenses and the largest containment."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)

        def scanned(ids: list, texts: list) -> pa.RecordBatch:
            found = scanner.scan(texts)
            names = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), names, pa.array([max(x.values(), default=0.0) for x in found], pa.float64())], names=["doc_id", "licenses", "containment"])

        for batch in batches:
            ids, texts, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(words(text.as_py()))
                total += len(texts[-1])
                if total > 1 << 18:
                    yield scanned(ids, texts)
                    ids, texts, total = [], [], 0
            if ids:
                yield scanned(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(per_partition, "doc_id long, licenses array<string>, containment double")

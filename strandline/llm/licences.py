"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Every unit of a document (the whole text, each paragraph and each line) is compared with the templates. Two bounds come
first and lose nothing: a coefficient of t needs sizes within t / (2 - t) of each other, and a unit that shares no
bigram with any template scores 0. The templates are a parameter of the job and travel with the task.

Narrow: no shuffle, one pass. Nulls: a null text has no units; a null id is kept. Repeated rows each give their rows. A
unit that scores alike with several templates takes the one first by name. A unit of one word has that word as its only
bigram. Texts of any length are whole in one row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

# Wordings of licence notices.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"
    ),
}
THRESHOLD = 0.8
WORD = re.compile(r"\w+(?:[.+-]+\w+)*")
BLANK_LINE, LINE_END = re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n")


def normalised(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter((w,) for w in words)


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.grams = {name: bigrams(normalised(text)) for name, text in sorted(templates.items())}
        self.sizes = {name: sum(g.values()) for name, g in self.grams.items()}
        self.holders: dict[tuple, list[str]] = {}
        for name, grams in self.grams.items():
            for gram in grams:
                self.holders.setdefault(gram, []).append(name)
        self.words = {w for gram in self.holders for w in gram}
        self.threshold, self.reach = threshold, threshold / (2 - threshold)
        self.least, self.most = min(self.sizes.values()) * self.reach, max(self.sizes.values()) / self.reach

    def best(self, unit: str) -> tuple[str, float] | None:
        """The template of the highest coefficient at or above the threshold."""
        words = normalised(unit)
        size = max(len(words) - 1, min(len(words), 1))
        if not self.least <= size <= self.most or self.words.isdisjoint(words):
            return None
        grams = bigrams(words)
        names = {n for g in grams for n in self.holders.get(g, ()) if self.reach * size <= self.sizes[n] <= size / self.reach}
        scores = [(-2 * (grams & self.grams[n]).total() / (size + self.sizes[n]), n) for n in names]
        if not scores:
            return None
        score, name = min(scores)
        return (name, -score) if -score >= self.threshold else None


def units(text: str) -> Iterator[tuple[int, int]]:
    """Start and end (code points) of the whole text, each paragraph and each line, each stretch once."""
    seen = set()
    for border in (None, BLANK_LINE, LINE_END):
        cuts = [(m.start(), m.end()) for m in border.finditer(text)] if border else []
        for start, end in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(text)], strict=True):
            part = text[start:end]
            span = (end - len(part.lstrip()), start + len(part.rstrip()))
            if span[0] < span[1] and span not in seen:
                seen.add(span)
                yield span


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())])


def scan(df: DataFrame, id_col: str, text_col: str, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each unit that matches: doc_id, start, end, licence, dice."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(templates, threshold)
        for batch in common.batches_of(batches, "text", 4_000_000):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, end in units(text or ""):
                    if found := held.best(text[start:end]):
                        out.append({"doc_id": doc_id, "start": start, "end": end, "licence": found[0], "dice": found[1]})
            yield pa.RecordBatch.from_pylist(out, schema=ROWS)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, "doc_id long, start long, end long, licence string, dice double")

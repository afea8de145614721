"""Licence scan by a positional index of rare words.

``TEMPLATES`` are wordings of licences and notices, with phrases that each must
hold.  Their words, with positions, are the index.  One pass over all texts counts
in how many documents each of these words occurs; the fewer, the rarer.  A second
pass looks up, for every document and template, the rarest words that the two
share.  A word at position p of the document and q of the template proposes that
the template starts at p - q.  A band of neighbouring starts holds a template if
at least half of its looked-up words propose a start inside the band and every
mandatory phrase stands at its place there.

Base phrases (``BASE``) are found besides, wherever their words stand
consecutively, and label the document on their own.

Scale: two passes of Arrow batches over the texts, without a shuffle but for the
counts, one row a task and indexed word.  Counts and index are as large as the
templates, whatever the input.  A document is reduced to the positions of indexed
words as it is read; documents without the words of any mandatory or base phrase
are done after one set operation.

Defined cases: null text is empty text (no words, no labels, score 0); equal rows
are judged alike; an empty table gives an empty result; of equally rare words the
first by code point counts as rarer; long texts are read whole, a piece at a time;
other columns of the input are carried along, and new columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from setforge.llm.shared import as_bytes, free_name, freeing, plain_words

#: Words of a template that are looked up in a document.
RARE = 16
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of public licences and usual notices, as (label, text, mandatory phrases).
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2 0",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("under the terms of the gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd", "Released under the BSD License", ("bsd license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("any purpose with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "authors be held liable")),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc0-1.0", "Released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
)


def words_of(text: str) -> list[bytes]:
    return [w for words in plain_words(text.encode()) for w in words]


@dataclass(frozen=True)
class Template:
    """A wording with its words' positions and where its mandatory phrases start."""

    label: str
    places: dict[bytes, list[int]]
    phrases: tuple[tuple[tuple[bytes, ...], int], ...]
    slack: int

    @classmethod
    def of(cls, label: str, text: str, phrases: tuple[str, ...]) -> Template:
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        for q, word in enumerate(words):
            places.setdefault(word, []).append(q)
        found = []
        for phrase in phrases:
            parts = tuple(words_of(phrase))
            starts = [q for q in range(len(words) - len(parts) + 1) if tuple(words[q : q + len(parts)]) == parts]
            if not parts or not starts:
                raise ValueError(f"the wording of {label} has no {phrase!r}")
            found.append((parts, starts[0]))
        if not found:
            raise ValueError(f"the wording of {label} needs a mandatory phrase")
        return cls(label, places, tuple(found), 1 + len(words) // 8)


class Scanner:
    """Templates and base phrases, with the number of documents that hold each of their words."""

    def __init__(self, templates: tuple = TEMPLATES, base: tuple = BASE, rare: int = RARE):
        self.templates, self.rare = [Template.of(*t) for t in templates], rare
        self.base = [(tuple(words_of(phrase)), label) for phrase, label in base]
        phrases = [p for p, _ in self.base] + [p for t in self.templates for p, _ in t.phrases]
        #: A document without all words of one of these has nothing to find.
        self.needed = [frozenset(p) for p, _ in self.base] + [frozenset(w for p, _ in t.phrases for w in p) for t in self.templates]
        self.words = sorted({w for t in self.templates for w in t.places} | {w for p in phrases for w in p})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.known, self.key = frozenset(self.words), frozenset().union(*self.needed) if self.needed else frozenset()
        self.counts = [0] * len(self.words)

    def counted(self, docs: DataFrame, text_col: str) -> Scanner:
        """Learn over all documents how rare the indexed words are."""
        known, number, size = self.known, self.number, len(self.words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size, np.int64)
            for batch in batches:
                for text in as_bytes(batch.column(0)):
                    held: set[bytes] = set()
                    for words in plain_words(text):
                        held |= known.intersection(words)
                    for word in held:
                        counts[number[word]] += 1
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["word", "n"])

        rows = docs.select(text_col).mapInArrow(freeing(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        for row in rows.collect():  # one row an indexed word
            self.counts[row["word"]] = row["n"]
        return self

    def rarity(self, word: bytes) -> tuple[int, bytes]:
        return self.counts[self.number[word]], word

    def read(self, text: bytes) -> tuple[int, dict[bytes, np.ndarray]]:
        """Number of words, and the positions of indexed words where a phrase may be held."""
        known, key, n = self.known, self.key, 0
        pieces = list(plain_words(text)) if len(text) <= 1 << 20 else None
        present: set[bytes] = set()
        for words in pieces if pieces is not None else plain_words(text):
            present |= key.intersection(words)
            n += len(words)
        if not any(need <= present for need in self.needed):
            return n, {}
        places: dict[bytes, list] = {}
        at = 0
        for words in pieces if pieces is not None else plain_words(text):
            found: dict[bytes, list[int]] = {}
            for i, word in enumerate(words, at):
                if word in known:
                    found.setdefault(word, []).append(i)
            for word, positions in found.items():
                places.setdefault(word, []).append(np.array(positions, np.int64))
            at += len(words)
        return n, {w: np.concatenate(parts) for w, parts in places.items()}

    @staticmethod
    def starts(places: dict[bytes, np.ndarray], phrase: tuple[bytes, ...]) -> np.ndarray:
        """Where the words of a phrase stand consecutively."""
        found = places.get(phrase[0], np.zeros(0, np.int64))
        for i, word in enumerate(phrase[1:], 1):
            found = found[np.isin(found + i, places.get(word, np.zeros(0, np.int64)))]
        return found

    def aligned(self, places: dict[bytes, np.ndarray], template: Template) -> tuple[int, float] | None:
        """Where the template starts, and its share of looked-up words, in the first of the bands that hold most of them."""
        phrases = []
        for phrase, q in template.phrases:
            found = self.starts(places, phrase)
            if not len(found):
                return None
            phrases.append(found - q)
        shared = sorted((w for w in template.places if w in places), key=self.rarity)[: self.rare]
        offsets = [np.unique((places[w][:, None] - np.array(template.places[w])).ravel()) for w in shared]
        bands = np.unique(np.concatenate([*offsets, *phrases]))

        def proposed(by: np.ndarray) -> np.ndarray:
            by = np.sort(by)
            return np.searchsorted(by, bands + template.slack, "right") > np.searchsorted(by, bands, "left")

        votes = sum(proposed(o).astype(np.int64) for o in offsets)
        whole = min(self.rare, len(template.places))
        holds = (2 * votes >= whole) & np.logical_and.reduce([proposed(p) for p in phrases])
        if not holds.any():
            return None
        best = np.flatnonzero(holds & (votes == votes[holds].max()))
        # bands that begin shortly before the first place hold it as well; the last of these begins there
        first = bands[best[bands[best] <= bands[best[0]] + template.slack][-1]]
        return int(first), int(votes[best[0]]) / whole

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
        """The values of ``FIELDS`` for one text."""
        n_words, places = self.read(text)
        if not places:
            return n_words, 0, None, None, "", "", 0.0, []
        base = [(starts, label) for phrase, label in self.base if len(starts := self.starts(places, phrase))]
        base_labels = {label for _, label in base}
        found = []
        for template in self.templates:
            if band := self.aligned(places, template):
                found.append({"label": template.label, "start": band[0], "share": band[1]})
        labels = base_labels | {f["label"] for f in found}
        score = max([0.5 if base else 0.0, *(f["share"] for f in found)])
        return (
            n_words, sum(len(starts) for starts, _ in base), min((int(s.min()) for s, _ in base), default=None), max((int(s.max()) for s, _ in base), default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found,
        )


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
MATCHES = ArrayType(StructType([StructField("label", StringType()), StructField("start", LongType()), StructField("share", DoubleType())]))
TYPES = ("long", "long", "long", "long", "string", "string", "double", MATCHES)
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, base: tuple = BASE, rare: int = RARE, with_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` (the text only ``with_text``) with the columns of ``FIELDS``.

    ``labels`` are those of base phrases and of templates; ``score`` is the largest
    share of a template's looked-up words in a band that holds it, at least 0.5
    beside a base phrase, 0 without either; ``matches`` says where each template
    starts.  The second result maps each of these to the column that holds it.
    """
    scanner = Scanner(templates, base, rare).counted(docs, text_col)
    at_text = docs.columns.index(text_col)
    held = [k for k in range(len(docs.columns)) if with_text or k != at_text]
    at = {f: free_name(docs, f) for f in FIELDS}
    schema = StructType([docs.schema.fields[k] for k in held])
    for f, t in zip(FIELDS, TYPES):
        schema = schema.add(at[f], t)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = sent.value.scan
        for batch in batches:
            if batch.num_rows:
                found = zip(*(scan(text) for text in as_bytes(batch.column(at_text))))
                new = [pa.array(column, t) for column, t in zip(found, _ARROW)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held), *new], names=[*(batch.schema.names[k] for k in held), *at.values()])

    return docs.mapInArrow(freeing(run), schema), at

"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.words import LETTERS_DIGITS, Words, words_of

#: Template words compared in one numpy step.
CELLS = 1 << 21
FOUND = "array<struct<label: string, base: boolean, start: bigint, words: int, share: double>>"


@dataclass(frozen=True)
class Template:
    """A license passage: at least ``least`` of its words, and all key phrases, must stand
    at their places; ``base`` marks templates whose places are reported by themselves."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    least: float = 0.8
    base: bool = False


# Phrases of the contract and the customary wording of license notices.
PHRASES = (
    Template("gpl", "gnu general public license", least=1.0, base=True),
    Template("apache", "apache license", least=1.0, base=True),
    Template("cc-by", "cc by", least=1.0, base=True),
    Template("mit", "mit license", least=1.0, base=True),
)
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0",
             ("Apache License, Version 2.0",)),
    Template("apache-2.0",
             "you may not use this file except in compliance with the License. You may obtain "
             "a copy of the License at", ("in compliance with the License",)),
    Template("gpl-3.0",
             "This work is licensed under the GNU General Public License, version 3",
             ("GNU General Public License, version 3",)),
    Template("gpl-3.0-or-later",
             "This program is free software: you can redistribute it and/or modify it under "
             "the terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later "
             "version", ("GNU General Public License", "version 3 of the License")),
    Template("gpl-2.0-or-later",
             "This program is free software; you can redistribute it and/or modify it under "
             "the terms of the GNU General Public License as published by the Free Software "
             "Foundation; either version 2 of the License, or (at your option) any later "
             "version", ("GNU General Public License", "version 2 of the License")),
    Template("lgpl-2.1-or-later",
             "This library is free software; you can redistribute it and/or modify it under "
             "the terms of the GNU Lesser General Public License as published by the Free "
             "Software Foundation; either version 2.1 of the License, or (at your option) any "
             "later version", ("GNU Lesser General Public License",)),
    Template("mit-notice", "Released under the MIT License", ("MIT License",)),
    Template("mit-text",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of "
             "this software and associated documentation files (the \"Software\"), to deal in "
             "the Software without restriction, including without limitation the rights to "
             "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
             "of the Software", ("to deal in the Software without restriction",)),
    Template("bsd",
             "Redistribution and use in source and binary forms, with or without "
             "modification, are permitted provided that the following conditions are met",
             ("source and binary forms", "the following conditions are met")),
    Template("isc",
             "Permission to use, copy, modify, and/or distribute this software for any "
             "purpose with or without fee is hereby granted",
             ("for any purpose with or without fee",)),
    Template("mpl-2.0",
             "This Source Code Form is subject to the terms of the Mozilla Public License, "
             "v. 2.0", ("Mozilla Public License",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("cc-by-4.0",
             "This work is licensed under a Creative Commons Attribution 4.0 International "
             "License", ("Creative Commons Attribution 4.0",)),
    Template("cc-by-sa-4.0",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
             "International License", ("Creative Commons Attribution-ShareAlike 4.0",)),
    Template("unlicense",
             "This is free and unencumbered software released into the public domain",
             ("released into the public domain",)),
)


def split(text: str) -> list[str]:
    """Words of a text as the scan sees them."""
    words = words_of(pa.array([text]), LETTERS_DIGITS)
    return words.text(np.arange(len(words.starts))).to_pylist()


@dataclass
class Compiled:
    """Templates as word numbers: names, and per template its numbers and mandatory places."""

    names: list[str]
    numbers: list[np.ndarray]
    needed: list[int]
    mandatory: list[np.ndarray]


def compile_templates(templates: Sequence[Template]) -> Compiled:
    names: dict[str, int] = {}
    numbers, needed, mandatory = [], [], []
    for t in templates:
        words = split(t.text)
        if not words:
            raise ValueError(f"template {t.label} has no words")
        must = np.zeros(len(words), bool)
        for phrase in t.phrases:
            own = split(phrase)
            at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            if not own or not at:
                raise ValueError(f"template {t.label} does not hold its phrase {phrase!r}")
            must[at[0] : at[0] + len(own)] = True
        numbers.append(np.array([names.setdefault(w, len(names)) for w in words]))
        needed.append(max(1, math.ceil(t.least * len(words) - 1e-9)))
        mandatory.append(np.flatnonzero(must))
    return Compiled(list(names), numbers, needed, mandatory)


class Lexicon:
    """Numbers of known words, found by their eight-byte pieces; others are -1."""

    def __init__(self, names: Sequence[str]) -> None:
        # Names are in lower case already and are one word each.
        held = words_of(pa.array(names, pa.string()), LETTERS_DIGITS)
        every = np.arange(len(names))
        self.depth = int((held.lengths.max(initial=1) + 7) // 8)
        self.pieces = [held.piece(every, d) for d in range(self.depth)]
        self.longest = 8 * self.depth
        self.heads = np.unique(self.pieces[0])
        self.order = np.lexsort(self.pieces[::-1])
        self.sorted = [p[self.order] for p in self.pieces]

    def numbers(self, words: Words) -> np.ndarray:
        count = len(words.starts)
        out = np.full(count, -1)
        if not len(self.heads) or not count:
            return out
        some = np.flatnonzero(words.lengths <= self.longest)
        head = words.piece(some, 0)
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        hit = self.heads[at] == head
        some = some[hit]
        # Bisection over all pieces at once, for the few words whose head is known.
        keys = [words.piece(some, d) for d in range(self.depth)]
        low, high = np.zeros(len(some), int), np.full(len(some), len(self.order))
        while np.any(low < high):
            mid = np.minimum((low + high) // 2, len(self.order) - 1)
            less, same = np.zeros(len(some), bool), np.ones(len(some), bool)
            for held, key in zip(self.sorted, keys, strict=True):
                less |= same & (held[mid] < key)
                same &= held[mid] == key
            going = low < high
            low = np.where(going & less, mid + 1, low)
            high = np.where(going & ~less, mid, high)
        at = np.minimum(low, len(self.order) - 1)
        same = np.logical_and.reduce(
            [held[at] == key for held, key in zip(self.sorted, keys, strict=True)]
        )
        out[some[same]] = self.order[at[same]]
        return out


def document_frequencies(documents: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """In how many documents each of some words occurs; the words are configuration."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(names)
        docs = np.zeros(len(names), np.int64)
        for batch in batches:
            words = words_of(batch.column(0), LETTERS_DIGITS)
            number = lexicon.numbers(words)
            seen = np.unique(words.rows[number >= 0] * len(names) + number[number >= 0])
            docs += np.bincount(seen % len(names), minlength=len(names))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(names))), pa.array(docs)], names=["word", "docs"]
        )

    found = (
        documents.select("text").mapInArrow(run, "word bigint, docs bigint")
        .groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    )
    return {name: 0 for name in names} | {names[r["word"]]: r["docs"] for r in found}


class Index:
    """Postings (template, place) of the rarest words of each template.

    A template of m words of which e may be missing keeps its e + v rarest places, so a
    place where enough words stand has at least v of them at the same relative position:
    the index leaves nothing out, whatever the frequencies are.
    """

    def __init__(self, compiled: Compiled, frequency: dict[str, int], votes: int) -> None:
        self.compiled = compiled
        self.votes, postings = [], defaultdict(list)
        for t, numbers in enumerate(compiled.numbers):
            missing = len(numbers) - compiled.needed[t]
            rare = sorted(
                range(len(numbers)),
                key=lambda k: (frequency[compiled.names[numbers[k]]],
                               compiled.names[numbers[k]], k),
            )
            own = min(votes, len(numbers) - missing)
            self.votes.append(own)
            for k in rare[: missing + own]:
                postings[int(numbers[k])].append((t, k))
        flat = [postings.get(w, []) for w in range(len(compiled.names))]
        self.count = np.array([len(p) for p in flat])
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.template = np.array([t for p in flat for t, _ in p])
        self.place = np.array([k for p in flat for _, k in p])
        self.votes = np.array(self.votes)
        self.longest = max(len(n) for n in compiled.numbers)

    def places(self, numbers: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """(template, word where it starts, share) for every place in a batch of words.

        Starts may lie before a text's first word if the passage was cut there.
        """
        some = np.flatnonzero(numbers >= 0)
        some = some[self.count[numbers[some]] > 0]
        if not len(some):
            return
        word = numbers[some]
        times = self.count[word]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        posting = np.repeat(self.first[word], times) + offset
        row = np.repeat(rows[some], times)
        start = np.repeat(some, times) - self.place[posting] + self.longest
        # Equal (template, relative position, text): the intersection of the postings.
        order = np.lexsort((row, start, self.template[posting]))
        template, start, row = self.template[posting][order], start[order], row[order]
        edge = np.ones(len(order), bool)
        edge[1:] = (
            (template[1:] != template[:-1]) | (start[1:] != start[:-1]) | (row[1:] != row[:-1])
        )
        at = np.flatnonzero(edge)
        enough = np.diff(np.append(at, len(order))) >= self.votes[template[at]]
        at = at[enough]
        for t in np.unique(template[at]):
            own = at[template[at] == t]
            expected = self.compiled.numbers[t]
            step = max(1, CELLS // len(expected))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                begin = start[part] - self.longest
                cell = begin[:, None] + np.arange(len(expected))
                held = np.clip(cell, 0, len(numbers) - 1)
                same = (numbers[held] == expected) & (rows[held] == row[part][:, None])
                same &= (cell >= 0) & (cell < len(numbers))
                right = same.sum(1)
                good = (right >= self.compiled.needed[t]) & same[
                    :, self.compiled.mandatory[t]
                ].all(1)
                yield int(t), row[part][good], begin[good], right[good] / len(expected)


def scan_licenses(
    documents: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    votes: int = 2,
    key: str = "doc_id",
) -> DataFrame:
    """License passages of every whole text: ``key``, n_words and the array ``found``.

    Needs the key and text; other columns are ignored.  Words are runs of digits, letters
    and code points from U+0080, with A-Z lower-cased.  A template is found where at least
    its ``least`` share of words, and all words of its key phrases, stand at their
    relative positions in one text.  ``found`` has label, base, start (words from 0, below
    0 if the passage was cut at the text's beginning), words (the template's) and share, in
    order of (start, label).  Null and empty texts have no words; repeated rows are texts
    of their own; an empty table gives no rows.

    One pass counts in how many texts each license word occurs.  A second looks up the
    words of each text that are the rarest of some template, intersects the postings by
    relative position and verifies what at least ``votes`` of them agree on.  The index
    holds templates only, so its size is that of the configuration.
    """
    templates = tuple(templates)
    compiled = compile_templates(templates)
    index = Index(compiled, document_frequencies(documents, compiled.names), votes)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(compiled.names)
        labels = np.array([t.label for t in templates], object)
        base = np.array([t.base for t in templates])
        sizes = np.array([len(n) for n in compiled.numbers])
        for batch in batches:
            words = words_of(batch.column(1), LETTERS_DIGITS)
            parts = [
                (np.full(len(r), t), r, s, share)
                for t, r, s, share in index.places(lexicon.numbers(words), words.rows)
            ]
            t, row, start, share = (
                map(np.concatenate, zip(*parts, strict=True)) if parts
                else (np.zeros(0, int),) * 3 + (np.zeros(0),)
            )
            start = start - words.first[row]
            order = np.lexsort((labels[t].astype(str), start, row))
            t, row, start, share = t[order], row[order], start[order], share[order]
            found = pa.StructArray.from_arrays(
                [
                    pa.array(labels[t], pa.string()), pa.array(base[t], pa.bool_()),
                    pa.array(start, pa.int64()), pa.array(sizes[t], pa.int32()),
                    pa.array(share, pa.float64()),
                ],
                names=["label", "base", "start", "words", "share"],
            )
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(words.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), found),
                ],
                names=[key, "n_words", "found"],
            )

    return documents.select(key, "text").mapInArrow(
        run, f"`{key}` {kind}, n_words bigint, found {FOUND}"
    )

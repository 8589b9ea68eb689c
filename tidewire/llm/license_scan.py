"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a window of 2 n words, n being the words of the template, and starts at any word. A block matches when it
holds at least `threshold` of the template's distinct words. The window slides over the places of template words with
running counts of distinct words; a window that starts elsewhere holds no more than the one at the next such place.
Words are ordered by their document frequency over all documents, rarest first. Documents and templates are joined by an
index from prefix words to templates: a match must hold one of the template's rarest n - need + 1 words, so a template is
looked at only where one of them stands. Two more filters, neither of which can lose a match: length (a document with
fewer distinct words than needed cannot match) and positional (from the first shared word on, what both sets still have
must suffice).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import text_slices

# Phrases that count as they stand, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of common licenses, (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents. One row per template word comes back."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = set(vocabulary), dict.fromkeys(vocabulary, 0)
        for b in text_slices(batches):
            for text in b.column(0).to_pylist():
                for w in wanted.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {bytes(r["word"]): r["n"] for r in rows}


class Template:
    """A template's words, rarest first, and what its filters need."""

    def __init__(self, label: str, text: str, frequency: dict[bytes, int], threshold: float):
        words = words_of(text)
        self.label, self.length = label, len(words)
        self.order = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(self.order)}
        n = len(self.order)
        self.need = next(k for k in range(1, n + 1) if k >= threshold * n - 1e-9)
        self.prefix = frozenset(self.order[: n - self.need + 1])

    def _places(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int]]:
        """(place, rank) of every template word, or nothing if the filters rule the document out."""
        shared = [r for r in range(len(self.order)) if self.order[r] in present]
        if len(shared) < self.need or len(self.order) - shared[0] < self.need:
            return []
        return [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]

    def _windows(self, at: list[tuple[int, int]], starts: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(start, distinct template words) of the matching windows among those at the ascending starts."""
        held, distinct, first, last = [0] * len(self.order), 0, 0, 0
        for a in starts:
            while last < len(at) and at[last][0] < a + 2 * self.length:
                r = at[last][1]
                distinct += not held[r]
                held[r] += 1
                last += 1
            while first < last and at[first][0] < a:
                r = at[first][1]
                held[r] -= 1
                distinct -= not held[r]
                first += 1
            if distinct >= self.need:
                yield a, distinct

    def passages(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int, float]]:
        """(first word, end, largest containment) of all matching blocks, those that overlap joined into one."""
        at = self._places(words, present)
        found: list[tuple[int, int, float]] = []
        for a, k in self._windows(at, (i for i, _ in at)):
            end, share = min(len(words), a + 2 * self.length), k / len(self.order)
            if found and a < found[-1][1]:
                first, _, best = found.pop()
                found.append((first, end, max(best, share)))
            else:
                found.append((a, end, share))
        return found


class Index:
    """Templates by their prefix words."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.templates = [Template(label, text, frequency, threshold) for label, text in templates]
        self.by_word: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t.prefix:
                self.by_word.setdefault(w, []).append(i)

    def candidates(self, present: set[bytes]) -> list[Template]:
        """The templates of which a prefix word is among a document's distinct words."""
        return [self.templates[i] for i in sorted({i for w in self.by_word.keys() & present for i in self.by_word[w]})]


def phrase_places(words: list[bytes], present: set[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases:
        if not present.issuperset(phrase):
            continue
        i = -1
        try:
            while True:
                i = words.index(phrase[0], i + 1)
                if words[i : i + len(phrase)] == phrase:
                    found.append((i, label))
        except ValueError:
            pass
    return found


SCHEMA = (
    "doc_id long, n_words long, places array<struct<start: int, label: string>>, "
    "blocks array<struct<label: string, first: int, end: int, containment: double>>"
)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, places (start, label) of phrases, blocks (label, first, end, containment).

    Matching blocks that overlap come as one, with the largest containment of them.

    Null texts count as empty and have no places or blocks. Repeated rows give repeated results, an empty table an empty
    one; other columns are ignored.
    """
    frequency = document_frequencies(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency, threshold)
        listed = [(words_of(p), label) for p, label in phrases.items()]
        place_type = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())]))
        block_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
        for b in text_slices(batches):
            counts, places, blocks = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                present = set(words)
                counts.append(len(words))
                places.append([{"start": i, "label": x} for i, x in phrase_places(words, present, listed)])
                blocks.append([{"label": t.label, "first": a, "end": e, "containment": c} for t in index.candidates(present) for a, e, c in t.passages(words, present)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(blocks, block_type)], ["doc_id", "n_words", "places", "blocks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def scan_digest(docs: DataFrame) -> DataFrame:
    """scan() -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment, else 0)."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("places.label")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("blocks.label"))).alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )

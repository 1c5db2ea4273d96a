"""License scans with a positional rare-token index.

The index holds licence templates as postings: word -> (template, position), and the
word's inverse document frequency over the templates.  For each file the scan

1. finds the file's words that are in the index (by 64-bit hash, in one NumPy pass);
2. looks up the postings of each template's own rare words, chosen when the index is built:
   each posting votes for (template, file position - template position);
3. keeps alignments with at least ``VOTES`` votes; the share of the template's words that
   stand in place at that alignment must reach ``COVERAGE``.  A template has so many rare
   places that no alignment of that coverage can miss the votes;
4. verifies that one of the template's mandatory key phrases stands in the aligned window.

The three base phrases are found at every place in the whole text: places of their last
word, then the words before it, and a comparison of the actual bytes.  A base phrase sets
its label whether or not a template aligns; the score is the best coverage, and at least
0.5 where a base phrase stands.

Work per file is linear in its words; nothing is kept between files, so memory is bounded
by one piece of text, and a lost executor costs its running tasks only.

Defined results: A-Z are lower-cased, no other letters; null texts count as empty (0
words, no labels, score 0); texts of any length are scanned whole; labels are sorted and
joined by commas, '' if there are none; of alignments that tie, each counts; repeated rows
and null identifiers are scanned like any other; an empty table gives an empty result;
result names replace input columns of the same name, whatever their case.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, other_fields
from .textkernel import ALNUM, LOWER, hash_bytes, loads, pieces, span_hashes, utf8, word_spans

VOTES, COVERAGE, SLACK = 3, 0.7, 4

#: Phrase -> label.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Fixed values: (label, text of the template, mandatory key phrases of which one must stand).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


class TemplateIndex:
    """Postings of templates by word hash, with IDF; small and fixed, sent with the code."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].split() for t in templates]
        self.phrases = [[p.split() for p in t[2]] for t in templates]
        self.base = [(p.split(), label) for p, label in base.items()]
        df = Counter(w for words in self.words for w in set(words))
        vocabulary = sorted({*df, *(w for p in self.phrases for q in p for w in q), *(w for p, _ in self.base for w in p)})
        hashes = np.array([hash_bytes(w.encode()) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.vocabulary = [vocabulary[i] for i in order]
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        n = len(templates)
        self.idf = [math.log((n + 1) / df[w]) if w in df else 0.0 for w in self.vocabulary]
        self.postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        for t, words in enumerate(self.words):
            for p, w in enumerate(words):
                self.postings[self.number[w]].append((t, p))
        # the rarest places of each template: all but VOTES of them may be out of place
        self.rare: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        self.enough = []
        for t, words in enumerate(self.words):
            least = next(c for c in range(len(words) + 1) if c / len(words) >= COVERAGE)
            self.enough.append(min(VOTES, least))
            order = sorted(range(len(words)), key=lambda p: (-self.idf[self.number[words[p]]], -len(words[p]), p))
            for p in order[: len(words) - least + self.enough[t]]:
                self.rare[self.number[words[p]]].append((t, p))

    def scan(self, places: dict[int, int], by_word: dict[int, list[int]]) -> tuple[set[str], float]:
        """Labels and best coverage of one file.  places: file position -> word number of
        its licence words; by_word: word number -> file positions."""
        votes: Counter[tuple[int, int]] = Counter((t, at - p) for w, spots in by_word.items() for t, p in self.rare[w] for at in spots)
        labels, best = set(), 0.0
        for (t, at), agree in votes.items():
            words = self.words[t]
            if agree < self.enough[t]:
                continue
            covered = sum(places.get(at + p) == self.number[w] for p, w in enumerate(words)) / len(words)
            if covered < COVERAGE or covered <= best and self.labels[t] in labels:
                continue
            window = range(at - SLACK, at + len(words) + SLACK)
            if any(self._stands(q, window, places) for q in self.phrases[t]):
                labels.add(self.labels[t])
                best = max(best, covered)
        return labels, best

    def _stands(self, phrase: list[str], window: range, places: dict[int, int]) -> bool:
        numbers = [self.number[w] for w in phrase]
        return any(all(places.get(s + i) == w for i, w in enumerate(numbers)) for s in window)


def _scan_batch(batch: pa.RecordBatch, text_col: str, index: TemplateIndex):
    n = batch.num_rows
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "n_base")}
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
    raw, offsets = utf8(batch.column(text_col))
    for a, _, data, at in pieces(raw, offsets):
        data = LOWER[data]
        starts, ends, word_at = word_spans(data, at, ALNUM)
        out["n_words"][a : a + len(at) - 1] = np.diff(word_at)
        if not len(starts):
            continue
        h = span_hashes(loads(data), starts, ends - starts)
        slot = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
        known = np.where(index.hashes[slot] == h, slot, -1)
        mine = np.flatnonzero(known >= 0)
        doc_of = np.searchsorted(word_at, mine, side="right") - 1
        # base phrases, at all places
        found: dict[int, set[str]] = {}
        for phrase, label in index.base:
            k = len(phrase)
            if len(known) < k:
                continue
            hit = np.ones(len(known) - k + 1, bool)
            for i, w in enumerate(phrase):
                hit &= known[i : len(known) - k + 1 + i] == index.number[w]
            for s in np.flatnonzero(hit):
                d = int(np.searchsorted(word_at, s, side="right")) - 1
                same = all(data[starts[s + i] : ends[s + i]].tobytes() == w.encode() for i, w in enumerate(phrase))
                if s + k <= word_at[d + 1] and same:
                    where = int(s - word_at[d])
                    out["n_base"][a + d] += 1
                    first[a + d] = where if first[a + d] < 0 else min(first[a + d], where)
                    last[a + d] = max(last[a + d], where)
                    found.setdefault(d, set()).add(label)
        # templates, in files with at least VOTES licence words
        some, at_mine = np.unique(doc_of, return_index=True)
        for d, lo, hi in zip(some, at_mine, [*at_mine[1:], len(mine)], strict=True):
            got, best = set(), 0.0
            if hi - lo >= VOTES:
                numbers = known[mine[lo:hi]].tolist()
                spots = (mine[lo:hi] - word_at[d]).tolist()
                by_word: dict[int, list[int]] = {}
                for p, w in zip(spots, numbers, strict=True):
                    by_word.setdefault(w, []).append(p)
                if len(by_word) >= VOTES:
                    got, best = index.scan(dict(zip(spots, numbers, strict=True)), by_word)
            base = found.get(int(d), set())
            base_labels[a + d] = ",".join(sorted(base))
            labels[a + d] = ",".join(sorted(base | got))
            score[a + d] = max(best, 0.5 if base else 0.0)
    none = first < 0
    return [
        pa.array(out["n_words"]),
        pa.array(out["n_base"]),
        pa.array(first, mask=none),
        pa.array(last, mask=none),
        pa.array(base_labels, pa.string()),
        pa.array(labels, pa.string()),
        pa.array(score),
    ]


RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score;
    input columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    kinds = [LongType()] * 4 + [StringType()] * 2 + [DoubleType()]
    fields = other_fields(docs, *RESULT, *([] if keep_text else [text_col]))
    schema = StructType([*fields, *(StructField(n, k) for n, k in zip(RESULT, kinds, strict=True))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + _scan_batch(batch, text_col, index), names + RESULT)

    return docs.mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)

"""Licence scans with a positional index of rare words.

The words of the licence templates are weighed by inverse document frequency over all documents and
posted with their positions. A file looks up its licence words of the highest weight: so many that
no template could reach ``MIN_SCORE`` by its other words alone. Postings that agree on where the
template would begin are intersected, and a place counts if what they weigh may still make up the
score and the template's key phrase stands there word by word. So no place with that score is lost.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are counted wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label: text of the template, and the key phrase that has to stand in its place.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-text": (
        "unless required by applicable law or agreed to in writing software distributed under the license"
        " is distributed on an as is basis without warranties or conditions of any kind",
        "as is basis",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use",
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0-1.0": ("cc0 1 0 universal public domain dedication", "public domain dedication"),
    "epl-2.0": ("this program is made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    "gpl-2.0": (
        "either version 2 of the license or at your option any later version", "version 2 of the license",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "general public license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify",
    ),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy",
        "permission is hereby granted",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain", "free and unencumbered software",
    ),
    "reserved": ("all rights reserved", "all rights reserved"),
}
MIN_SCORE = 0.6  # share of a template's weight that has to be in place

# Bytes outside of words become spaces, A-Z becomes a-z; bytes from 0x80 on belong to words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_OUT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
    " base_labels string, labels string, score double"
)


class Rules(NamedTuple):
    """Phrases, templates and their weights, ready for a scan."""

    phrases: list  # words, label, place of the rarest word
    templates: list  # words, weights, label, place and words of the key phrase
    postings: dict  # word: [(template, place)]
    gates: list  # weight of each template's postings that has to agree on a place, at least
    anchors: frozenset  # every word that a scan looks for


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def word_weights(documents: DataFrame, words: Sequence[bytes], text_col: str = "text") -> dict:
    """``ln((N + 1) / (df + 1))`` of each word, counted over all documents."""
    listed = frozenset(words)

    def count(batches):
        found, rows = defaultdict(int), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0).to_pylist():
                for word in listed.intersection(words_of(text)):
                    found[word] += 1
        # At most one row for each listed word, and one for the number of documents.
        keys = [*found, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([*found.values(), rows], pa.int64())],
            ["word", "n"],
        )

    counts = documents.select(text_col).mapInArrow(count, "word binary, n bigint")
    totals = {
        None if row["word"] is None else bytes(row["word"]): row["n"]
        for row in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()
    }
    total = totals.get(None, 0)
    return {word: math.log((total + 1) / (totals.get(word, 0) + 1)) for word in listed}


def rules_of(
    documents: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, tuple[str, str]] = TEMPLATES,
    text_col: str = "text",
) -> Rules:
    """Weigh the words over ``documents`` and build the positional index of the templates."""
    split = {label: (words_of(text), words_of(key)) for label, (text, key) in templates.items()}
    said = [(words_of(phrase), label) for phrase, label in phrases.items()]
    every = {w for ws, _ in [*split.values(), *said] for w in ws}
    idf = word_weights(documents, sorted(every), text_col)
    rarest = lambda ws: max(range(len(ws)), key=lambda i: (idf[ws[i]], -i))
    listed, gates, postings = [], [], defaultdict(list)
    for number, (label, (words, key)) in enumerate(sorted(split.items())):
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        weights = [idf[w] + 1e-9 for w in words]
        listed.append((words, weights, label, at, key))
        rest, least = sum(weights), MIN_SCORE * sum(weights)
        for place in sorted(range(len(words)), key=lambda i: (-weights[i], i)):
            if rest < least:
                break
            postings[words[place]].append((number, place))
            rest -= weights[place]
        gates.append(least - max(rest, 0.0))
    counted = [(words, label, rarest(words)) for words, label in said]
    anchors = frozenset(postings) | {words[at] for words, _, at in counted}
    return Rules(counted, listed, dict(postings), gates, anchors)


def scan_words(words: list[bytes], rules: Rules) -> tuple:
    """``n_base, first, last, base labels, labels, score`` of one file."""
    hits = [(i, w) for i, w in enumerate(words) if w in rules.anchors]
    base, starts, count = set(), [], 0
    for phrase, label, at in rules.phrases:
        rare = phrase[at]
        for i, w in hits:
            if w == rare and i >= at and words[i - at : i - at + len(phrase)] == phrase:
                starts.append(i - at)
                base.add(label)
                count += 1
    agree: dict = defaultdict(float)
    for i, w in hits:
        for template, place in rules.postings.get(w, ()):
            agree[template, i - place] += rules.templates[template][1][place]
    labels, best = set(base), 0.0
    for (template, begin), weight in agree.items():
        text, weights, label, at, key = rules.templates[template]
        if weight < rules.gates[template] * (1 - 1e-9) or begin + at < 0:
            continue
        if words[begin + at : begin + at + len(key)] != key:
            continue
        there = sum(
            weight
            for place, (word, weight) in enumerate(zip(text, weights))
            if 0 <= begin + place < len(words) and words[begin + place] == word
        )
        score = min(1.0, there / sum(weights))
        if score >= MIN_SCORE:
            labels.add(label)
            best = max(best, score)
    return (
        count, min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), best,
    )


def scan_licenses(
    documents: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: words, places of the base phrases, labels, and a score.

    ``first_word`` and ``last_word`` are the smallest and the largest start of a base phrase,
    counted in words from 0, or null. ``labels`` are those of the phrases and of the templates,
    sorted and joined by commas, "" if there are none. ``score`` is the largest weighted share
    of a template's words in place, 0 without one. A null text counts as empty; repeated rows are
    scanned each; an empty table gives no rows; other columns are ignored.
    """
    rules = rules_of(documents, phrases, templates, text_col)

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                rows.append((len(words), *scan_words(words, rules)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                 "labels", "score"],
            )

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(scan, _OUT)

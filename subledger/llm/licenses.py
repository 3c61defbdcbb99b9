"""Licence notices by a positional index of their rarest words.

Every notice is a template of words. How many documents hold each template word is counted
over all documents. A template is found through the rarest words of its key phrases: each
place of such a word in a text proposes where the template would begin, a place that enough
of them agree on is a candidate, and a candidate counts if all its key phrases stand there.
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.text import ALPHANUMERIC, documents, lowered, slices, span_hashes, words_of

# The phrases of the contract and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Label, notice, key phrases that must stand in it.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "gnu general public license version 2", ("public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "creative commons zero v1 0 universal", ("creative commons zero",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files",
        ("permission is hereby granted free of charge", "copy of this software"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products",
        ("nor the names of its contributors", "endorse or promote products"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
        ("permission to use copy modify", "without fee is hereby granted"),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released",)),
)
ANCHORS = 3  # rarest words by which a template is looked up
SLACK = 2  # words by which a key phrase may have moved


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, int], ...]  # first word and number of words
    base: bool


def templates() -> list[Template]:
    out = []
    for phrase, label in BASE:
        words = tuple(phrase.encode().split())
        out.append(Template(label, words, ((0, len(words)),), True))
    for label, notice, phrases in NOTICES:
        words, spans = tuple(notice.encode().split()), []
        for phrase in phrases:
            key = tuple(phrase.encode().split())
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            spans.append((at, len(key)))
        out.append(Template(label, words, tuple(spans), False))
    return out


class Vocabulary(NamedTuple):
    words: list[bytes]
    hashes: np.ndarray  # ascending
    order: np.ndarray  # index of the word that has each hash


def vocabulary(found: list[Template]) -> Vocabulary:
    words = sorted({w for t in found for w in t.words})
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = span_hashes(data, np.append(0, ends[:-1]), ends)
    order = np.argsort(hashes)
    return Vocabulary(words, hashes[order], order)


def _hits(hashes: np.ndarray, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is among the sorted ones, and its index there."""
    at = np.searchsorted(sorted_hashes, hashes)
    at[at == len(sorted_hashes)] = 0
    where = np.flatnonzero(sorted_hashes[at] == hashes)
    return where, at[where]


def word_document_counts(df: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many rows each template word occurs; as many entries as the templates have words."""
    known = vocabulary(templates())

    def run(batches):
        for batch in batches:
            total = np.zeros(len(known.words), dtype=np.int64)
            for texts in slices(batch.column(0)):
                words = words_of(texts, low := lowered(texts.data), ALPHANUMERIC)
                where, which = _hits(span_hashes(low, words.starts, words.ends), known.hashes)
                row = np.searchsorted(words.rows, where, side="right")
                pairs = np.unique(row * len(known.words) + known.order[which])
                total += np.bincount(pairs % len(known.words), minlength=len(known.words))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    counted = df.select(df[text]).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n"))
    return {known.words[w]: n for w, n in counted.collect()}


class Index(NamedTuple):
    templates: list[Template]
    weights: list[np.ndarray]  # of each template's words
    anchors: np.ndarray  # ascending hashes of the words looked up
    postings: list[np.ndarray]  # by anchor word: template, place in it
    needed: np.ndarray  # by template: agreeing words that make a candidate


def positional_index(counts: dict[bytes, int], n_rows: int) -> Index:
    """Templates under their rarest words."""
    found = templates()
    known = vocabulary(found)
    hash_of = {known.words[i]: h for h, i in zip(known.hashes.tolist(), known.order, strict=True)}
    idf = {w: math.log((1 + n_rows) / (1 + counts.get(w, 0))) + 1e-6 for w in known.words}
    by_word: dict[int, list[tuple[int, int]]] = {}
    for t, template in enumerate(found):
        # A key phrase must stand whole, so its rarest words find every place of it.
        phrases = [range(at, at + n) for at, n in template.phrases]
        phrase = max(phrases, key=lambda p: max(idf[template.words[k]] for k in p))
        places = sorted(phrase, key=lambda p: (-idf[template.words[p]], p))[:ANCHORS]
        for p in places:
            by_word.setdefault(hash_of[template.words[p]], []).append((t, p))
    anchors = np.array(sorted(by_word), dtype=np.uint64)
    postings = [np.array(by_word[int(h)], dtype=np.int64) for h in anchors]
    weights = [np.array([idf[w] for w in t.words]) for t in found]
    return Index(found, weights, anchors, postings, np.array([min(2, len(t.words)) for t in found]))


def _candidates(index: Index, hashes: np.ndarray) -> list[tuple[int, int]]:
    """Template and the word position where it would begin."""
    where, which = _hits(hashes, index.anchors)
    if not len(where):
        return []
    found, begins = [], []
    for a, posting in enumerate(index.postings):
        places = where[which == a]
        if len(places):
            found.append(np.repeat(posting[:, 0], len(places)))
            begins.append((places[None, :] - posting[:, 1][:, None]).ravel())
    keys = np.concatenate(found) + len(index.templates) * (np.concatenate(begins) + (1 << 20))
    keys, agreeing = np.unique(keys, return_counts=True)
    template = keys % len(index.templates)
    keys, template = keys[ok := agreeing >= index.needed[template]], template[ok]
    return list(zip(template.tolist(), (keys // len(index.templates) - (1 << 20)).tolist(), strict=True))


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its words, base places (count, first, last), labels and the best score.

    The score is the weight of the best confirmed template's words that stand in their
    places, of all its words; 0 where nothing is confirmed. Null counts as empty.
    """
    index = positional_index(word_document_counts(df, text), df.count())

    def same(data, words, place: int, word: bytes) -> bool:
        return bytes(data[words.starts[place] : words.ends[place]]) == word

    def standing(data, words, first: int, last: int, begin: int, t: Template) -> bool:
        for at, n in t.phrases:
            moves = (0,) if t.base else sorted(range(-SLACK, SLACK + 1), key=abs)
            if not any(
                first <= begin + at + m
                and begin + at + m + n <= last
                and all(same(data, words, begin + at + m + k, t.words[at + k]) for k in range(n))
                for m in moves
            ):
                return False
        return True

    def run(batches):
        for batch in batches:
            rows = []
            for texts in slices(batch.column(1)):
                low = lowered(texts.data)
                words = words_of(texts, low, ALPHANUMERIC)
                hashes = span_hashes(low, words.starts, words.ends)
                bounds = words.rows.tolist()
                n = len(bounds) - 1
                base, labels, scores = [[] for _ in range(n)], [set() for _ in range(n)], [0.0] * n
                named = [set() for _ in range(n)]
                for t, begin in _candidates(index, hashes):
                    template = index.templates[t]
                    key_place = min(max(begin + template.phrases[0][0], 0), len(hashes) - 1)
                    row = int(np.searchsorted(words.rows, key_place, side="right")) - 1
                    first, last = bounds[row], bounds[row + 1]
                    if not standing(low, words, first, last, begin, template):
                        continue
                    labels[row].add(template.label)
                    if template.base:
                        base[row].append(begin - first)
                        named[row].add(template.label)
                    there = [
                        first <= begin + k < last and same(low, words, begin + k, w)
                        for k, w in enumerate(template.words)
                    ]
                    weight = index.weights[t]
                    scores[row] = max(scores[row], float(weight[there].sum() / weight.sum()))
                for i in range(n):
                    rows.append(
                        (
                            bounds[i + 1] - bounds[i],
                            len(base[i]),
                            min(base[i], default=None),
                            max(base[i], default=None),
                            ",".join(sorted(named[i])),
                            ",".join(sorted(labels[i])),
                            min(1.0, scores[i]),
                        )
                    )
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    names = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [df.schema[key].dataType.simpleString(), *["long"] * 4, "string", "string", "double"]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, types, strict=True))
    return df.select(df[key], df[text]).mapInArrow(run, schema).withColumnRenamed("key", key)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir, "doc_id", "text"))

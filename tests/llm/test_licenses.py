import re

from subledger.llm import licenses
from tests.llm.common import awkward_texts, documents, with_tables

TEXTS = [
    "Released under the MIT License.",
    "GNU General Public License, version 3. gnu GENERAL public-license",
    "Licensed under CC BY-NC 4.0.",
    "mit mit license license cc cc by by",
    "mit der Apache Lizenz",
    "General Public License, version 2",  # the first template word is missing
    "Apache",
    "License. Apache License, Version 2.0",
    "Permission is hereby granted, free of charge, to any and every person obtaining a copy of this software",
    "permission is hereby granted",
    "apache\x00license ápache license apache-license apacheé license",
]


def expected(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        key = phrase.split()
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark, tmp_path):
    texts = [*TEXTS, *awkward_texts()]
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts))
    rows = {r.doc_id: r for r in licenses.op7_license_scan(spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_labels_of_the_method(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark, TEXTS))
    labels = {r.doc_id: r.labels for r in licenses.op7_license_scan(spark, folder).collect()}
    assert labels[0] == "mit"
    assert labels[1] == "gpl,gpl-3.0"
    assert labels[2] == "cc-by,cc-by-nc"
    assert labels[4] == "" and labels[6] == "" and labels[9] == ""
    assert labels[5] == "gpl-2.0"
    assert labels[7] == "apache,apache-2.0"
    assert labels[8] == "mit"


def test_empty_table(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark).limit(0))
    assert licenses.op7_license_scan(spark, folder).collect() == []

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from subledger.llm import pair_index
from subledger.llm.library_ids import library_cache
from subledger.llm.pair_index import Merges, PairIndex
from subledger.llm.text import slices
from tests.llm.common import awkward_texts, documents, special_texts, two_letter_words, with_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts() -> list[str | None]:
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdefghij ABC/+9=") for _ in range(5000)) for _ in range(4)]
    return [*awkward_texts(), *special_texts(), *two_letter_words(1024), *two_letter_words(2048), *noise, "ab" * 4000, "x" * 9999]


def test_merges_follow_the_ranks(tmp_path, monkeypatch):
    rng = random.Random(2)
    letters = pair_index.byte_letters()
    vocabulary, merges, parts = {c: i for i, c in enumerate(letters)}, [], ["a", "b", "c"]
    while len(merges) < 40:
        a, b = rng.choice(parts), rng.choice(parts)
        if a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            merges.append([a, b])
            parts.append(a + b)
    file = json.load(open(PATH, encoding="utf-8"))
    file["model"] |= {"vocab": vocabulary, "merges": merges}
    file["added_tokens"] = []
    (tmp_path / "small.json").write_text(json.dumps(file))
    library, own = Tokenizer.from_file(str(tmp_path / "small.json")), Merges(str(tmp_path / "small.json"))
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for few in (0, 4, 10**9):  # all lists at once, both ways, all one by one
        monkeypatch.setattr(pair_index, "FEW", few)
        index = PairIndex(own, [p.encode() for p in pieces])
        index.merge()
        assert index.ids() == [library.encode(p).ids for p in pieces]
    file["model"]["merges"] = merges[::-1]
    (tmp_path / "wrong.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="later merge"):
        Merges(str(tmp_path / "wrong.json"))


def test_query_equals_the_library(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts()).repartition(3))
    library = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in pair_index.op13_pair_index_bpe(spark, folder).collect()}
    assert len(rows) == len(texts())
    for i, text in enumerate(texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_ids_and_texts_as_columns(spark):
    ids = pair_index.encoded(documents(spark, texts()), PATH)
    back = {r.doc_id: r.text for r in pair_index.texts_of(ids, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    some = spark.createDataFrame([(1, [0xE0, 50256]), (2, None), (2, [])], "doc_id long, ids array<int>")
    library = Tokenizer.from_file(PATH)
    found = sorted((r.doc_id, r.text or "") for r in pair_index.texts_of(some, PATH).collect())
    assert found == [(1, library.decode([0xE0, 50256], skip_special_tokens=False)), (2, ""), (2, "")]


def test_empty_table_and_repeated_rows(spark, tmp_path):
    assert pair_index.digests(documents(spark).limit(0), PATH).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in pair_index.digests(twice, PATH).collect()) == [0, 2, 2]


def test_a_text_beyond_a_slice():
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(1_000_000)]
    text = " ".join(words)
    assert len(text) > 4 << 20
    library = Tokenizer.from_file(PATH).encode(text).ids
    for part in slices(pa.array([text, "b"], pa.string())):
        for cache in (pair_index.coder(PATH).cache, library_cache(PATH)):
            ids, rows = cache.encoded(part)
            if part.first == 0:
                assert ids[: rows[1]].tolist() == library

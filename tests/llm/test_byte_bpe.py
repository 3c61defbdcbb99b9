import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from subledger.llm import byte_bpe
from subledger.llm.byte_bpe import Transducer, Utf8Stream, decoded, read_ranks
from tests.llm.common import awkward_texts, documents, special_texts, two_letter_words, with_tables

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={}
    )


def test_transducer_follows_the_merges():
    rng = random.Random(2)
    ranks = {bytes([b]): b for b in range(256)}
    pieces = [b"a", b"b", b"c"]
    while len(ranks) < 290:
        new = rng.choice(pieces) + rng.choice(pieces)
        if new not in ranks:
            ranks[new] = len(ranks)
            pieces.append(new)
    library = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for most in (5, 10_000):  # with hardly any room for states, and with plenty
        transducer = Transducer(ranks, most_states=most, most_pairs=50)
        for _ in range(2000):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
            assert transducer.encode(text.encode()) == library.encode_ordinary(text)


def test_query_equals_the_library(spark, tmp_path, library):
    texts = [*awkward_texts(), *special_texts(), *two_letter_words(1024), *two_letter_words(2048)]
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts).repartition(2))
    rows = {r.doc_id: r for r in byte_bpe.op8_byte_bpe(spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_ids_and_texts_as_columns(spark, library):
    df = documents(spark)
    ids = byte_bpe.encoded(df, PATH)
    back = {r.doc_id: r.text for r in byte_bpe.texts_of(ids, PATH).collect()}
    for i, text in enumerate(awkward_texts()):
        assert back[i] == (text or "")
    assert {r.doc_id: list(r.ids) for r in ids.collect()}[4] == library.encode_ordinary("one")


def test_empty_table(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark).limit(0))
    assert byte_bpe.op8_byte_bpe(spark, folder).collect() == []


def test_streaming_decode_holds_back_open_characters():
    token = {b: bytes([b]) for b in range(256)}
    text = "aé中🙂z"
    assert list(decoded(text.encode(), token)) == list(text)
    for raw in (b"a\xffb", b"\xc3", b"\xe4\xb8", b"\xf0\x9f\x99", b"\xe0\x80a", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        for cut in range(len(raw) + 1):
            stream = Utf8Stream()
            parts = stream.feed(raw[:cut]) + stream.feed(raw[cut:]) + stream.close()
            assert parts == raw.decode("utf-8", errors="replace")

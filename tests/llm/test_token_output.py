import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from subledger.llm import mixing_coder
from subledger.llm.mixing_coder import BadBlock, decode_block, encode_block
from tests.llm.common import awkward_texts, documents, special_texts, two_letter_words, with_tables

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trips():
    rng = np.random.default_rng(1)
    cases = [
        np.empty(0, int), np.array([5]), np.zeros(5000, int), np.tile(np.arange(300), 400),
        rng.integers(0, 50_257, 30_000), rng.zipf(1.3, 20_000) % 50_000, np.array([(1 << 19) - 1, 0] * 300),
    ]
    for ids in cases:
        block = decode_block(encode_block(ids, np.array([len(ids)])))
        assert (block.ids == ids).all() and block.lengths.tolist() == [len(ids)]
    assert len(encode_block(np.tile(np.arange(300), 400), np.array([120_000]))) < 60_000
    with pytest.raises(ValueError, match="not supported"):
        encode_block(np.array([1 << 19]), np.array([1]))


def test_damage_is_found():
    rng = np.random.default_rng(2)
    data = encode_block(rng.integers(0, 900, 4000), np.array([1500, 2500]))
    for at in (0, 5, 17, 30, len(data) // 2, len(data) - 40):
        broken = bytearray(data)
        broken[at] ^= 0x41
        with pytest.raises(BadBlock):
            decode_block(bytes(broken))
    for cut in (0, 10, 40):
        with pytest.raises(BadBlock):
            decode_block(data[:cut])


@pytest.mark.parametrize("block_ids", [1 << 20, 64])
def test_query_equals_the_library(spark, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(mixing_coder, "BLOCK_IDS", block_ids)
    library = Tokenizer.from_file(TOKENIZER)
    texts = [*awkward_texts(), *special_texts(), *two_letter_words(1024), *two_letter_words(2048)]
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts).repartition(4))
    rows = {r.doc_id: r for r in mixing_coder.op6_token_output(spark, folder).collect()}
    assert len(rows) == len(texts)
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens) == (start, len(ids))
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_ids_come_back(spark, tmp_path):
    df = spark.createDataFrame([(2, "b c"), (None, "a"), (2, None)], "doc_id long, text string")
    path = str(tmp_path / "blocks")
    mixing_coder.write_ids(df, path, TOKENIZER, 2)
    found = mixing_coder.read_ids(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids[-1]) for r in found][0] == (None, 2, 2)
    assert sorted(r.n_tokens for r in found) == [1, 2, 3]


def test_empty_table(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark).limit(0))
    assert mixing_coder.op6_token_output(spark, folder).collect() == []


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_block():
    ids = (np.random.default_rng(3).zipf(1.3, 1 << 21) % 50_000).astype(np.int32)
    lengths = np.full(1 << 10, 1 << 11)
    data = encode_block(ids, lengths)
    assert peak_mb(lambda: encode_block(ids, lengths)) < 50
    assert peak_mb(lambda: decode_block(data)) < 35
    assert (decode_block(pa.py_buffer(data)).ids == ids).all()


def test_memory_of_encoding():
    words = ["the", "of", "thing", "eau", "über", "x1", "(token)", "end."]
    text = " ".join(np.random.default_rng(4).choice(words, 2000))
    column = pa.array([text] * 800)  # 8 MB
    assert sum(len(t.bounds) - 1 for t, _, _ in mixing_coder.encoded(column, TOKENIZER, 2)) == 800
    peak = peak_mb(lambda: [None for _ in mixing_coder.encoded(column, TOKENIZER, 2)])
    assert peak < 60, peak

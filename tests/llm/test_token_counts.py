import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from subledger.llm import token_counts
from tests.llm.common import awkward_texts, documents, special_texts, two_letter_words, with_tables


def test_equals_the_library(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True  # the separator's string is text
    texts = [*awkward_texts(), *special_texts(), *two_letter_words(1024), *two_letter_words(2048)]
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts).repartition(4))
    rows = {r.doc_id: r for r in token_counts.op4_token_counts(spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
    start = 0
    for r in sorted(rows.values(), key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens + 1


def test_documents_across_blocks(spark):
    ids = np.array([9, 1, 2, 3, 9, 9, 4, 5, 6, 7, 8, 1, 9, 2], dtype="<u4")
    for size in (1, 2, 3, 5, 20):
        blocks = [(f, i, bytearray(ids[k : k + size].tobytes())) for f in (0, 1) for i, k in enumerate(range(0, 14, size))]
        df = spark.createDataFrame(blocks, "file int, block int, data binary")
        got = sorted(map(tuple, token_counts.counted(token_counts.separators(df, 9)).collect()))
        one = [(0, 0, 0, 0), (0, 1, 1, 3), (0, 2, 5, 0), (0, 3, 6, 6)]
        assert got == one + [(1, n, s + 14, c) for _, n, s, c in one]


def test_raw_files(spark, tmp_path):
    np.array([1, 2, 50256, 3, 50256], dtype="<u4").tofile(tmp_path / "a.bin")
    np.array([50256], dtype="<u4").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    blocks = token_counts.blocks_of_files(spark, str(tmp_path), block_ids=2)
    found = token_counts.counted(token_counts.separators(blocks, 50256)).collect()
    assert sorted((r.start, r.n_tokens) for r in found) == [(0, 2), (3, 1), (5, 0)]


def test_empty_table(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark).limit(0))
    assert token_counts.op4_token_counts(spark, folder).collect() == []


def test_documents_are_not_broadcast(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark, awkward_texts()))
    plan = token_counts.op4_token_counts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [file#" in plan and plan.count("BroadcastHashJoin") == 1  # of one row a file


SMALL_HEAP = """
import sys
from types import SimpleNamespace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from subledger.llm import token_counts

conf = {"master": "local[2]", "ui.enabled": "false", "ui.showConsoleProgress": "false", "driver.memory": "512m"}
spark = SparkSession.builder.config(map={f"spark.{k}": v for k, v in conf.items()}).getOrCreate()
bytes_as_ids = SimpleNamespace(encoded=lambda texts: (texts.data.astype("int32"), texts.bounds))
token_counts.library_cache = lambda path, special: bytes_as_ids
docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(9999)).alias("text"))
token_counts.write_flat(docs, sys.argv[1], "", 50256)
counts = token_counts.token_counts(spark, sys.argv[1], 50256)
wrong = counts.where("n_tokens <> 9999 or start <> doc_id * 10000").count()
print("rows", counts.count(), "wrong", wrong)
"""


def test_file_larger_than_half_the_heap(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", SMALL_HEAP, str(tmp_path / "flat")],
        env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])},
        capture_output=True, text=True, timeout=300,
    )
    assert "rows 8000 wrong 0" in run.stdout, run.stderr[-3000:]

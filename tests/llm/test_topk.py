import math
import random

import pytest

from subledger.llm import topk
from tests.llm.common import with_tables

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5):
    whole = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for row, (q, a) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for r, (i, b) in enumerate(whole) if r != row)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, folder):
    return sorted(map(tuple, topk.op9_exact_topk(spark, folder).select("query_id", "rank", "vec_id", "score").collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], "x") for i in range(700)]
    same = rows[0][1]
    rows += [(i, same, "x") for i in range(700, 1000)]  # ties
    rows += [(1000, None, "x"), (1050, [None, *[0.0] * 7], "x"), (1100, [float("nan"), *[0.0] * 7], "x")]
    rows += [(1150, [float("inf"), *[0.0] * 7], "x"), (None, same, "x"), (1200, [], "x"), (1201, [1.0], "x")]
    rng.shuffle(rows)
    folder = with_tables(spark, tmp_path, embeddings=table(spark, rows).repartition(3))
    assert run(spark, folder) == brute(rows)
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert sorted(map(tuple, topk.top_k(df, df.vec_id % 50 == 0, block=7).collect())) == brute(rows)


def test_several_query_batches(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)], "x") for i in range(400)]
    df = table(spark, rows)
    found = topk.top_k(df, df.vec_id % 50 == 0, batch=4)
    assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("sample", [8192, 3])
def test_repeated_ids_are_candidates(spark, monkeypatch, sample):
    monkeypatch.setattr(topk, "SAMPLE", sample)
    monkeypatch.setattr(topk, "BATCHES_A_JOB", 2)
    rng = random.Random(5)
    rows = [(rng.choice([i, 50, 100, 7]), [rng.gauss(0, 1) for _ in range(3)], "x") for i in range(150)]
    rows += rows[:20] + [(50, [1.0, 1.0, 1.0], "x")] * 12
    df = table(spark, rows).repartition(3)
    assert sorted(map(tuple, topk.top_k(df, df.vec_id % 50 == 0, batch=4).collect())) == brute(rows)


def test_blocks_of_grouped_vectors_are_skipped(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], "x") for i in range(4000)]
    df = table(spark, rows)
    assert sorted(map(tuple, topk.top_k(df, df.vec_id % 50 == 0).collect())) == brute(rows)
    assert topk.scored_share(df, df.vec_id % 50 == 0, block=32) < 0.3


def test_few_rows(spark, tmp_path):
    one = table(spark, [(50, [0.5], "x"), (51, [0.25], "x")])
    assert run(spark, with_tables(spark, tmp_path, embeddings=one)) == [(50, 1, 51, 128 * 64)]
    assert run(spark, with_tables(spark, tmp_path, embeddings=one.limit(0))) == []

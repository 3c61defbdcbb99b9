"""Quality, decontamination and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subledger.llm import decontamination, ngram_join, quality
from tests.llm.common import awkward_texts, documents, with_tables

LABELS = "doc_id long, quality int, toxic int"


def good(rng) -> str:
    return ". ".join(" ".join(rng.choice(VOCABULARY) for _ in range(12)) for _ in range(rng.randrange(2, 8)))


def junk(rng) -> str:
    text = good(rng)
    return text.upper().replace(" ", "!! ") if rng.random() < 0.5 else text.replace(" ", "%%% ")


VOCABULARY = [f"{a}{b}" for a in ("ther", "ing", "ation", "on", "sh") for b in ("al", "er", "ed", "um", "is", "o")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    kinds = [0 if rng.random() < 0.2 else 1 for _ in range(400)]
    return kinds, [good(rng) if k else junk(rng) for k in kinds]


def labels_of(spark, kinds, n):
    rows = [(i, k, 0) for i, k in enumerate(kinds[:n])] + [(None, 1, 0), (9999, 0, 0), (5, None, None)]
    return spark.createDataFrame(rows, LABELS)


def test_held_out_quality(spark, tmp_path, corpus):
    kinds, texts = corpus
    folder = with_tables(
        spark, tmp_path, documents=documents(spark, [*texts, *awkward_texts()]), labels=labels_of(spark, kinds, 200)
    )
    rows = {r.doc_id: r for r in quality.op1_quality_classifier(spark, folder).collect()}
    assert len(rows) == len(texts) + len(awkward_texts())
    right = [rows[i].quality == kinds[i] for i in range(200, 400)]
    assert np.mean(right) >= 0.97
    assert all(0 <= s <= 1 for r in rows.values() for s in (r.text_score, r.page_score, r.quality_score))


def features_of(rng, n):
    """Good and poor texts whose words tell them apart half the time, and their source nearly always."""
    kinds = np.array([rng.random() < 0.6 for _ in range(n)], dtype=int)
    columns, rows = [], []
    for i, kind in enumerate(kinds):
        for _ in range(12):
            columns.append(rng.randrange(400) if rng.random() < 0.85 else 400 + 50 * kind + rng.randrange(50))
            rows.append(i)
    sparse = quality.Sparse(np.array(rows), np.array(columns), np.full(len(rows), quality.SCALE / 12), n)
    looks = np.array([[rng.gauss(0, 1) for _ in range(quality.LOOK_COLUMNS)] for _ in range(n)])
    pages = quality.page(np.zeros(n, int), np.array([2 * rng.randrange(8) + (k if rng.random() < 0.93 else 1 - k) for k in kinds]), np.full(n, 9.0))
    return kinds, sparse, looks, pages


def test_views_teach_each_other():
    """With few labels the exchange changes both models, and the held-out rows are told better."""
    gains, apart = [], []
    for seed in range(5):
        rng = random.Random(seed)
        kinds, sparse, looks, pages = features_of(rng, 1500)
        labels = np.where(np.arange(1500) < 60, kinds, -1)
        test = np.arange(900, 1500)
        right = []
        for rounds in (0, quality.ROUNDS):
            model = quality.co_trained(sparse, looks, pages, labels, 0.6, rounds)
            scores = model.scores(sparse.times(model.text[: quality.BUCKETS]), looks, pages)
            right.append((scores[test] >= 0.5).astype(int) == kinds[test, None])
            if rounds == 0:
                before = model
        assert not np.allclose(before.text, model.text) and not np.allclose(before.page, model.page)
        apart.append(right[1].mean(axis=0) - right[0].mean(axis=0))
        gains.append(right[1][:, 2].mean())
    text_gain, _, joint_gain = np.mean(apart, axis=0)
    assert text_gain > 0.02 and joint_gain > -0.01 and np.mean(gains) > 0.9


def test_the_sample_takes_one_row_of_a_key(spark, corpus):
    texts = corpus[1][:6]
    df = documents(spark, texts).withColumn("doc_id", F.expr("doc_id % 2")).union(documents(spark, texts).withColumn("doc_id", F.expr("doc_id % 2")))
    keys = spark.createDataFrame([(0, 1), (1, 0)], "key long, label int")
    rows = quality._sample(df, keys)
    assert rows["key"].to_pylist() == [0, 1]
    again = quality._sample(df.orderBy(F.rand(3)).repartition(3), keys)
    assert again.to_pylist() == rows.to_pylist()


def test_no_or_one_sided_labels_reject_nothing(spark, corpus):
    df = documents(spark, corpus[1][:20])
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0)]):
        assert quality.accepted(df, spark.createDataFrame(labels, LABELS)).count() == 20
    assert quality.accepted(df.limit(0), labels_of(spark, corpus[0], 50)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def smith_waterman(a, b) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_leaks_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"q{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)] + [None, "", "two words", "É Ñu wé çà"]
    items.append(items[0])  # equal items
    texts = []
    for _ in range(150):
        text = [word() for _ in range(rng.randrange(0, 80))]
        own = (rng.choice(items[:12])).split()
        for _ in range(rng.randrange(0, len(own))):  # edits, from none to many
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [word()], [own[at].upper() + ",", word()]])
            own = own or ["x"]
        texts.append(" ".join(text + own + text[::-1]))
    texts += [*awkward_texts(), "é ñu WÉ ÇÀ", (items[3] + " ") * 30]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    folder = with_tables(spark, tmp_path, documents=documents(spark, texts), benchmark=bench)
    rows = decontamination.op3_decontamination(spark, folder).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own, whole = words(item), words(text)
            share = smith_waterman(own, whole) / (2 * len(own)) if len(own) >= 3 else 0
            if share >= 0.85:  # seeds surely remain
                assert found[d, i].score == pytest.approx(share)
                first, last = found[d, i].first_word, found[d, i].last_word
                assert smith_waterman(own, whole[first:last]) == round(share * 2 * len(own))
            elif share < decontamination.LEAK:
                assert (d, i) not in found


def test_many_item_batches(spark, monkeypatch):
    texts = [" ".join(f"a{i}b{j}" for j in range(10)) for i in range(20)]
    df, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    monkeypatch.setattr(decontamination, "ITEM_BATCH", 8)
    found = decontamination.with_leaks(df, bench).select("doc_id", "leaks.item_id").collect()
    assert {(r.doc_id, tuple(r.item_id)) for r in found} == {(i, (i,)) for i in range(20)}
    none = bench.limit(0)
    assert decontamination.clean(df, none).count() == 20
    assert decontamination.clean(df.limit(0), bench).columns == df.columns


def test_stages_and_run(spark, tmp_path, corpus):
    kinds, texts = corpus
    rng = random.Random(6)
    bench = [" ".join(f"z{rng.randrange(900)}" for _ in range(20)) for _ in range(5)]
    extra = [texts[kinds.index(1)], "plain " + bench[2] + " end", good(rng) + " password=hunter2222 end.", None, ""]
    df = documents(spark, [*texts, *extra], extra=False)
    folder = with_tables(
        spark, tmp_path, documents=df, labels=labels_of(spark, kinds, 300),
        benchmark=spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"),
    )
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}.out")
        docs = spark.read.parquet(f"{folder}/{name}.out")
        seen[name] = docs
        if name != "byte_level_bpe":
            assert docs.schema == df.schema
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    n = len(texts)
    kept = {r.doc_id for r in seen["quality_classifier"].collect()}
    assert np.mean([(i in kept) == bool(kinds[i]) for i in range(n)]) >= 0.97
    groups = {r.component_id for r in ngram_join.near_duplicates(seen["quality_classifier"]).collect()}
    assert {r.doc_id for r in seen["ngram_jaccard_join"].collect()} == groups
    assert n not in groups and n + 1 not in {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    scanned = {r.doc_id: r for r in seen["secret_scan"].collect()}
    secret = extra[2].replace("password=hunter2222", "<assign>")
    assert scanned[n + 2].text == secret and scanned[n + 2].n_chars == len(secret)
    result = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert result == {r.doc_id: list(r.ids) for r in seen["byte_level_bpe"].collect()}
    assert set(result) == set(scanned)

"""Edited copies of benchmark items against brute force, down to the least score."""

import random

import pytest

from subledger.llm import decontamination
from tests.llm.common import documents
from tests.llm.test_pipeline import smith_waterman, words


def edited(rng: random.Random, own: list[str]) -> list[str]:
    """Words replaced at a fixed pace, words put in between, or any edits."""
    fresh = lambda: f"n{rng.randrange(1 << 30)}"
    kind, pace = rng.randrange(4), rng.choice([3, 4, 5, 6])
    if kind == 0:
        return [fresh() if k % pace == pace - 1 else w for k, w in enumerate(own)]
    if kind == 1:
        share = rng.choice([0.2, 0.5, 0.7])
        return [x for w in own for x in ([w, fresh()] if rng.random() < share else [w])]
    out = list(own)
    for _ in range(rng.randrange(0, 1 + len(own) // 2)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [fresh()], [out[at], fresh()], [rng.choice(own)]])
        out = out or ["x"]
    return out


def test_every_edited_copy_is_found(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("the of and".split()) if rng.random() < 0.3 else f"q{rng.randrange(400)}"
    items = [" ".join(word() for _ in range(n)) for n in [*range(3, 21), 20, 25, 30, 33, 40]]
    texts = []
    for n in range(400):
        around = [word() for _ in range(rng.randrange(0, 40))]
        own = edited(rng, items[n % len(items)].split())
        texts.append(" ".join(around + own + around[::-1]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.with_leaks(documents(spark, texts), bench).select("doc_id", "leaks").collect()
    found = {(r.doc_id, x.item_id): x for r in rows for x in r.leaks}
    edge = 0
    for d, text in enumerate(texts):
        whole = words(text)
        for i, item in enumerate(items):
            own = words(item)
            share = smith_waterman(own, whole) / (2 * len(own))
            edge += decontamination.LEAK <= share < 0.8
            assert ((d, i) in found) == (share >= decontamination.LEAK)
            if (d, i) in found:
                x = found[d, i]
                assert x.score == pytest.approx(share)
                assert smith_waterman(own, whole[x.first_word : x.last_word]) == round(share * 2 * len(own))
    assert edge > 50


@pytest.mark.parametrize("pace", [4, 5, 6])
def test_a_word_in_every_few_replaced(spark, pace):
    item = [f"w{k}" for k in range(20)]
    copy = [f"x{k}" if k % pace == pace - 1 else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for texts in ([" ".join(copy)], [" ".join(copy), " ".join(item)]):
        assert decontamination.clean(documents(spark, texts), bench).count() == 0


def test_excerpts_of_long_items(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("the of and".split()) if rng.random() < 0.3 else f"q{rng.randrange(4000)}"
    items = [" ".join(word() for _ in range(n)) for n in (45, 57, 70, 90, 150, 400)]
    texts, found = [], {}
    for n in range(120):
        own = items[n % len(items)].split()
        size = rng.randrange(15, min(len(own), 120))
        at = rng.randrange(len(own) - size)
        own = own[at : at + size]
        if n % 2:
            pace = rng.choice([5, 6, 9])
            own = [f"n{rng.randrange(1 << 30)}" if k % pace == pace - 1 else w for k, w in enumerate(own)]
        texts.append(" ".join([word() for _ in range(60)] + own + [word() for _ in range(60)]))
    own = items[1].split()
    texts.append(" ".join(own[10:40]))  # 30 words of 57: 0.53
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for r in decontamination.with_leaks(documents(spark, texts), bench).select("doc_id", "leaks").collect():
        found |= {(r.doc_id, x.item_id): x.score for x in r.leaks}
    parts = 0
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own = words(item)
            best = smith_waterman(own, words(text))
            leak = best >= min(2 * decontamination.LONG, 2 * len(own) * decontamination.LEAK)
            parts += leak and best < 2 * len(own) * decontamination.LEAK
            assert ((d, i) in found) == leak
            assert not leak or found[d, i] == pytest.approx(best / (2 * len(own)))
    assert parts > 20
    assert found[len(texts) - 1, 1] == pytest.approx(30 / 57)
    assert decontamination.clean(documents(spark, texts[-1:]), bench).count() == 0

"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from subledger.llm import spelling
from subledger.llm.text import slices
from tests.llm.common import awkward_texts, documents, two_letter_words, with_tables

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(run: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def occurrences(rows):
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            yield run


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = {w: n for w, n in Counter(occurrences(rows)).items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def edited(rng: random.Random, word: str) -> str:
    at, letter = rng.randrange(len(word)), rng.choice("abcéÀÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def corpus() -> list[str | None]:
    rng = random.Random(11)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    words += ["Straße", "École", "école", "x×y÷zz", "naïve", "Naive", "naive", *two_letter_words(1024), "q" * 300]
    words += [edited(rng, w) for w in words for _ in range(rng.randint(0, 6))]
    words += [edited(rng, w) for w in words]
    weights = [rng.choice([1, 2, 5, 20]) for _ in words]
    texts = [rng.choice([" ", "-", "\n", "1"]).join(rng.choices(words, weights, k=rng.randrange(120))) for _ in range(150)]
    return [*texts, *texts[:20], *awkward_texts()]


@pytest.mark.parametrize("group, block, cells", [(512, 64, 1 << 22), (91, 8, 300)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, group, block, cells):
    for name, value in (("GROUP", group), ("BLOCK", block), ("CELLS", cells), ("HELD", group)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(12)
    rows = [(rng.choice([i, i, 5, None]), t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    folder = with_tables(spark, tmp_path, documents=df.repartition(3))
    got = spelling.op12_spelling_variants(spark, folder).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(found) == len(got) > 200 and found == expected(rows)
    assert any(r.root not in (r.word, r.form) for r in got)


def test_crowded_groups_are_split_until_they_fit(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 100)
    rng = random.Random(13)
    words = {"prefixprefix" + "".join(rng.choice("abcdef") for _ in range(12)) for _ in range(400)}
    words |= {"".join(rng.choice("abcdef") for _ in range(12)) + "suffixsuffix" for _ in range(400)}
    words |= {edited(rng, w) for w in list(words)}
    table = spark.createDataFrame([(w, 3 + i % 9) for i, w in enumerate(sorted(words))], "word string, n long")
    members = spelling.grouped(table)
    assert members.groupBy("key").count().agg({"count": "max"}).first()[0] <= 100
    got = {r.word: r.s for r in spelling.compared(members).groupBy("word").agg({"n_near": "sum"}).withColumnRenamed("sum(n_near)", "s").collect()}
    for w in words:
        assert got.get(w, 0) == sum(v != w and abs(len(v) - len(w)) < 2 and is_near(v, w) for v in words)


def test_checksums_equal_the_library():
    texts = corpus()
    for part in slices(pa.array(texts, pa.string()), 1 << 12):
        low, words = spelling.letter_runs(part)
        before = [zlib.crc32(f"{k}:".encode()) for k in range(len(words.starts))]
        found = spelling.checksums(low, words, spelling.np.array(before, dtype=spelling.np.uint32))
        for a, b, k, h in zip(words.starts, words.ends, range(len(before)), found.tolist(), strict=True):
            assert h == zlib.crc32(f"{k}:".encode() + low[a:b].tobytes())
        for k in range(part.last - part.first):
            own = [low[words.starts[i] : words.ends[i]].tobytes().decode() for i in range(words.rows[k], words.rows[k + 1])]
            assert own == [lowered(r) for r in RUN.findall(texts[part.first + k] or "")]


def test_empty_table_and_few_words(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=documents(spark).limit(0))
    assert spelling.op12_spelling_variants(spark, folder).collect() == []
    rows = spelling.variants(documents(spark, ["alpha", "alpha alpha", "beta beta beta", None])).collect()
    assert {(r.word, r.root, r.n, r.n_near) for r in rows} <= {("alpha", "alpha", 3, 0)}

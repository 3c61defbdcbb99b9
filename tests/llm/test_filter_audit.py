"""The filter audit against plain Python, and its counts against a walk through every order."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa

from subledger.llm import filter_audit
from subledger.llm.text import slices
from tests.compare import assert_same
from tests.llm.common import awkward_texts, documents, two_letter_words, with_tables

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[str | None]:
    rng = random.Random(3)
    out = [*awkward_texts(), *two_letter_words(1024), " ".join(two_letter_words(1024) * 30)]
    for _ in range(150):
        words = [rng.choice(["a", "The", "X#", "é", f"w{rng.randrange(200)}", "UP"]) for _ in range(rng.randrange(90))]
        out.append(" ".join(words) + rng.choice(["", "", " 5%", "\n|", "\x1c", "\x0b"]))
    return out + [rng.choice(out) for _ in range(80)]


def failed(rows) -> list[frozenset]:
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = WORDS.findall(text)
        tests = (
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            key is not None and least[text] < key,
        )
        out.append(frozenset(f for f, t in zip("ABCDE", tests, strict=True) if t))
    return out


def walked(rows, labels) -> dict:
    """Every document through every order, one filter after another."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    found = Counter()
    for (key, _, part), fails in zip(rows, failed(rows), strict=True):
        part = part or ""
        for order in permutations("ABCDE"):
            left = True
            for step, f in enumerate(order, 1):
                at = (part, "".join(order), step)
                hit = f in fails
                found[(*at, "removed")] += hit and left
                found[(*at, "redundant")] += hit and not left
                found[(*at, "unique_fails")] += hit and len(fails) == 1
                found[(*at, "good_lost")] += hit and left and key in good
                found[(*at, "toxic_lost")] += hit and left and key in toxic
                found[(part, f, "shapley")] += hit and left
                left = left and not hit
                found[(*at, "kept")] += left
    return found


def test_measures_of_texts():
    texts = corpus()
    for part in slices(pa.array(texts, pa.string()), 1 << 12):
        words, distinct, capitals, points, symbols = filter_audit.measured(part)
        for i, text in enumerate(texts[part.first : part.last]):
            own = WORDS.findall(text or "")
            assert (words[i], distinct[i]) == (len(own), len(set(own)))
            assert capitals[i] == len(re.findall("[A-Z]", text or ""))
            assert (points[i], symbols[i]) == (len(text or ""), len(re.findall("[#$%&*|]", text or "")))


def test_words_are_told_apart_by_bytes_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    texts = ["a b a c b a", "", None, "b b", "longer words longer words x"]
    (part,) = slices(pa.array(texts, pa.string()))
    assert filter_audit.measured(part)[1].tolist() == [3, 0, 0, 1, 3]


def test_audit_equals_a_walk_and_sql(spark, tmp_path):
    texts = corpus()
    rng = random.Random(8)
    rows = [(rng.choice([i, i, i, 7, None]), t, rng.choice(["s0", "s0", "s1", None, ""])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, len(texts), 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, n int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    folder = with_tables(spark, tmp_path, documents=df.repartition(3), labels=known)
    result = filter_audit.op11_filter_audit(spark, folder)
    expected = walked(rows, labels)
    got = result.collect()
    assert len(got) == 120 * 5 * 3 == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        at = (r.part, r.filter_order, r.step)
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == expected[(*at, name)], (at, name)
        assert r.shapley == expected[(r.part, r.filter_order[r.step - 1], "shapley")]
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert_same(result, con, filter_audit.OP11_SQL)


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = with_tables(spark, tmp_path, documents=documents(spark).limit(0), labels=labels)
    assert filter_audit.op11_filter_audit(spark, none).collect() == []
    assert filter_audit.audit(documents(spark, ["a", None]), labels).where("filter_order = 'ABCDE' and step = 1").count() == 1

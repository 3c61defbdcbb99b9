"""Substring dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from subledger.llm import ngram_join, substring_dedup
from subledger.llm.components import components
from tests.llm.common import awkward_texts, documents, two_letter_words, with_tables

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def copies(rng: random.Random) -> list[str | None]:
    """Exact and near copies, a shared passage, a hot line, repeated rows, texts of few words."""
    word = lambda: rng.choice("the of and".split()) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    base, passage, out = text(150), text(70), []
    for _ in range(40):
        out.append(" ".join(base))
    for _ in range(60):
        edited = list(base)
        for _ in range(rng.randrange(1, 8)):
            edited[rng.randrange(len(edited))] = word()
        out.append(" ".join(edited))
    for _ in range(60):
        own = text(rng.randrange(5, 120))
        at = rng.randrange(len(own))
        out.append(" ".join(own[:at] + passage + own[at:]))
    out += [" ".join(text(rng.randrange(1, 200))).upper() for _ in range(30)]
    twice = text(80)
    out += [" ".join(twice + twice), "a b", "A  b", "a b c d e", "a b c d e f", "x", "x"]
    for size in (1024, 2048):  # alone, and as the one word in which long texts differ
        alike, around = two_letter_words(size), text(60)
        out += [*alike, *[" ".join([*around[:30], w, *around[30:]]) for w in alike], *[" ".join([w, "a", "b", "c", "d"]) for w in alike]]
    return [*out, *awkward_texts()]


def kept(texts):
    docs = [WORDS.findall(t or "") for t in texts]
    least: dict[tuple, int] = {}
    for d, words in enumerate(docs):
        for i in range(len(words) - 49):
            least.setdefault(tuple(words[i : i + 50]), d)
    out = []
    for d, words in enumerate(docs):
        gone = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        text = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return out


def joined(texts):
    sets = []
    for t in texts:
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in enumerate(sets)]


@pytest.fixture(scope="module")
def corpus():
    texts = copies(random.Random(7))
    random.Random(8).shuffle(texts)
    return texts


@pytest.mark.parametrize("few", [64, 1])
def test_substring_dedup(spark, tmp_path, corpus, monkeypatch, few):
    monkeypatch.setattr(substring_dedup, "FEW", few)  # 1: every prefix goes to full length
    monkeypatch.setattr(substring_dedup, "KEY_BROADCAST", 1 << 20 if few > 1 else 0)
    folder = with_tables(spark, tmp_path, documents=documents(spark, corpus).repartition(3))
    rows = substring_dedup.op2_substring_dedup(spark, folder).collect()
    assert sorted(map(tuple, rows)) == kept(corpus)


@pytest.mark.parametrize("pairs_at_once", [2, 0])
def test_ngram_join(spark, tmp_path, corpus, monkeypatch, pairs_at_once):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", pairs_at_once)
    monkeypatch.setattr(ngram_join, "KEY_BROADCAST", 1 << 20 if pairs_at_once else 0)
    folder = with_tables(spark, tmp_path, documents=documents(spark, corpus).repartition(3))
    rows = ngram_join.op5_ngram_join(spark, folder).collect()
    assert sorted(map(tuple, rows)) == joined(corpus)


def test_one_of_each_group_stays(spark, corpus):
    df = documents(spark, corpus)
    left = ngram_join.deduplicated(df)
    assert left.columns == df.columns
    groups = {d: (c if n else -1 - d) for d, n, c in joined(corpus)}
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(ids) == sorted(d for d, c in groups.items() if c in (d, -1 - d))
    again = df.where("doc_id < 5").union(df.where("doc_id < 5"))
    assert Counter(r.doc_id for r in ngram_join.deduplicated(again).collect()).most_common(1)[0][1] == 1


def test_null_keys_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (4, text), (None, "a"), (7, None)], "doc_id long, text string")
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.kept_words(df).collect()}
    assert found == {(None, 60, 60), (4, 60, 0), (None, 1, 0), (7, 0, 0)}
    found = {tuple(r) for r in ngram_join.near_duplicates(df).collect()}
    assert found == {(None, 56, 4), (4, 56, 4), (None, 1, None), (7, 0, 7)}
    assert substring_dedup.kept_words(df.limit(0)).collect() == []
    assert ngram_join.near_duplicates(df.limit(0)).collect() == []


def test_lists_of_batches_spread_over_buckets(spark):
    df = spark.range(2000, numPartitions=400).selectExpr("id as doc", "0L as version", "'x' as text")
    places = [r.bucket for r in ngram_join._emit(df, 64, 5).where("docs is not null").select("bucket").collect()]
    assert len(places) >= 400 and len(set(places)) > 32 and max(Counter(places).values()) < len(places) / 8


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if x not in alone}


def test_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(0, 200), dtype=np.uint64)) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert ngram_join.suffix_bound(a, b, 3) <= apart
        bits = ngram_join.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist()
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*bits, strict=True)) <= apart


def test_many_shared_ngrams_in_one_bucket():
    n = 70_000  # beyond sixteen bits
    own, who = np.arange(n, dtype=np.uint32).tobytes(), np.zeros(n, np.uint16).tobytes()
    docs = [[{"doc": d, "version": 1, "n": n, "name": b"s%d" % d, "shared": 0}] for d in (0, 1)]
    bucket = pa.table(
        {"batch": [0, 1, 0, 1], "grams": [None, None, own, own], "who": [None, None, who, who], "docs": [*docs, None, None]}
    )
    found = ngram_join._shared_in_bucket(bucket)
    for batch in (0, 1):
        counted = ngram_join._shared_in_batch(found.filter(pa.array([b == batch for b in found["batch"].to_pylist()])))
        assert counted["shared"].to_pylist() == [n]


@pytest.mark.parametrize("n", [63, 64, 65, 500])
def test_anchors_beyond_the_places_that_fit(monkeypatch, n):
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 6)
    values = np.random.default_rng(2).integers(0, 1 << 12, n, dtype=np.uint64)
    coarse = (values >> np.uint64(6)).tolist()
    expected = [min(range(k, k + 43), key=lambda i: (coarse[i], i)) for k in range(n - 42)]
    assert substring_dedup.least_places(values, 43).tolist() == expected


def test_last_step_meets_in_blocks(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "TURNS", 1)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    folder = with_tables(spark, tmp_path, documents=documents(spark, corpus).repartition(3))
    assert sorted(map(tuple, ngram_join.op5_ngram_join(spark, folder).collect())) == joined(corpus)


def test_blocks_are_bounded_and_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    lengths = {f"s{k}": 50 + k % 150 for k in range(400)}
    rows = [(7, name, n, int(name[1:]) < 300, 400, 300) for name, n in lengths.items()]
    rows += [(8, name, 10, True, 2, 2) for name in ("s0", "s1")]
    entries = spark.createDataFrame(rows, "gram long, name string, n int, out boolean, sets long, outside long")
    found = []
    for outside, some in ((True, entries.where("out")), (False, entries)):
        under = {}
        for r in ngram_join._in_blocks(some, 80, outside).collect():
            under.setdefault((r.gram, r.band, r.block), []).append(r.name)
        assert max(map(len, under.values())) <= 3 * 20
        found.append(under)
    pairs = Counter((k[0], a, b) for k, names in found[0].items() for a in names for b in found[1].get(k, ()))
    assert set(pairs.values()) == {1}
    fits = {(7, a, b) for a in lengths if int(a[1:]) < 300 for b in lengths if 5 * min(lengths[a], lengths[b]) >= 4 * max(lengths[a], lengths[b])}
    assert fits <= pairs.keys() and {(8, a, b) for a in ("s0", "s1") for b in ("s0", "s1")} <= pairs.keys()

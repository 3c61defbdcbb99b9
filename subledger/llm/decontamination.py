"""Benchmark passages in documents: rare seeds, then Smith-Waterman alignment.

A match adds 2, a changed, added or missing word takes 1. The best local score, as a share of
the score of the item with itself, says how much of it the document holds, edited or not. An
alignment is a leak from ``LEAK`` on, whatever the item's length also if it scores as much as
``LONG`` unbroken words: an excerpt of a long item.

Seeds are pairs of neighbouring words. An alignment with few enough edits for its score has a
least number of intact pairs, in a bounded number of words (``demands``). An item leaves out
its commonest pairs, but so few that ``AGREEING`` of the intact ones are always seeds. Where
seeds lie close enough together, a bound on the score is taken from the words the item has,
and what can reach the score is aligned. So no alignment from ``LEAK`` on is passed over, and none
of an excerpt that scores enough and is at ``LEAK`` or more of that part of the item.
Items too short for that have single words for seeds.

Items are sent to the tasks in batches of bounded size, each of which meets all documents.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.batches import added, with_column
from subledger.llm.text import ALPHANUMERIC, documents, grams, slices, span_hashes, words_of
from subledger.sources.shared_folder import staged

N = 3  # least words of an item
AGREEING = 2  # seeds that propose an alignment, or all that one surely has if those are fewer
LEAK = 0.6  # share of an item's own score
LONG = 25  # words whose score is a leak whatever share of the item they are
ITEM_BATCH = 8192
FILTER_BITS = 20


class Items(NamedTuple):
    ids: list
    words: list[np.ndarray]  # hashes
    widths: np.ndarray  # words of each item's seeds
    agreeing: np.ndarray  # seeds of each item that an alignment surely has
    reaches: np.ndarray  # words of a document that hold so many seeds of it
    spans: np.ndarray  # words of a document that an alignment takes at most
    seeds: np.ndarray  # ascending hashes
    bounds: np.ndarray  # of each seed's owners
    owners: np.ndarray  # items
    times: np.ndarray  # how often an owner has the seed
    filter: np.ndarray

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and positions of seeds in the words of a slice, and which seeds."""
        found = []
        for width in np.unique(self.widths[self.owners]).tolist():
            values = grams(hashes, width)
            near = np.flatnonzero(self.filter[(values & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            at = np.searchsorted(self.seeds, values[near])
            at[at == len(self.seeds)] = 0
            true = self.seeds[at] == values[near]
            where, at = near[true], at[true]
            row = np.searchsorted(rows, where, side="right") - 1
            inside = where + width <= rows[row + 1]
            found.append((row[inside], where[inside], at[inside]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 3


def demands(length: int, least: float) -> tuple[int, int, int, int]:
    """Words of a seed, seeds an alignment surely has, in how many words, and words it takes at most.

    Of m matches and e edits the score is 2 m - e. The matches form at most e + 1 runs, so at
    least m - e - 1 pairs are intact: the score less m, less 1. The alignment takes at most
    m + e words, three times m less the score. m is at most the words of the item's part.

    A part that is long enough for ``LONG`` at ``least`` can be cut into pieces that just are;
    one of them has ``least`` of its own score, and has the seeds.
    """
    own, long = max(1, math.ceil(2 * length * least - 1e-6)), 2 * LONG
    score, pairs = min(own, long), own - length - 1
    reach = span = 3 * length - score
    if own > long:
        piece = int(long / (2 * least)) + 1
        pairs = min(pairs, long - piece)
        reach = min(reach, math.ceil((3 - 2 * least) * (2 * piece - 1)))
    if pairs >= 1:
        return 2, pairs, reach, span
    return 1, -(-score // 2), span, span


def lower_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a column: first row, hashes of the lower-cased words, and where rows begin."""
    for part in slices(pc.utf8_lower(texts)):
        words = words_of(part, part.data, ALPHANUMERIC)
        yield part.first, span_hashes(part.data, words.starts, words.ends), words.rows


def items_of(ids: list, texts: pa.Array, least: float) -> Items:
    """Items under all their seeds; those under N words have none."""
    words: list[np.ndarray] = []
    for _, hashes, rows in lower_slices(texts):
        words += [hashes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    asked = np.array([demands(len(w), least) for w in words], dtype=np.int64).reshape(-1, 4)
    sure = np.minimum(asked[:, 1], AGREEING)
    every, owners, times = [np.empty(0, np.uint64)], [], []
    for i, w in enumerate(words):
        if len(w) >= N:
            own, n = np.unique(grams(w, int(asked[i, 0])), return_counts=True)
            every.append(own)
            owners += [i] * len(own)
            times += n.tolist()
    none = Items(ids, words, asked[:, 0], sure, asked[:, 2], asked[:, 3], *[np.empty(0, np.int64)] * 5)
    return under(none, np.concatenate(every), np.array(owners, np.int64), np.array(times, np.int64))


def under(items: Items, every: np.ndarray, owners: np.ndarray, times: np.ndarray) -> Items:
    """The items under these seeds."""
    order = np.argsort(every, kind="stable")
    seeds, first = np.unique(every[order], return_index=True)
    near = np.zeros(1 << FILTER_BITS, dtype=bool)
    near[(seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    bounds = np.append(first, len(every))
    return items._replace(seeds=seeds, bounds=bounds, owners=owners[order], times=times[order], filter=near)


def seed_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each seed occurs; as many numbers as the batch has seeds."""

    def run(batches):
        for batch in batches:
            total = np.zeros(len(items.seeds), dtype=np.int64)
            for _, hashes, rows in lower_slices(batch.column(0)):
                row, _, which = items.hits(hashes, rows)
                pairs = np.unique(row * len(items.seeds) + which)
                total += np.bincount(pairs % len(items.seeds), minlength=len(items.seeds))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    counts = np.zeros(len(items.seeds), dtype=np.int64)
    if len(counts):
        found = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n")).collect()
        for seed, n in found:
            counts[seed] = n
    return counts


def rarest(items: Items, counts: np.ndarray, least: float) -> Items:
    """The items without their commonest seeds; enough stay for all alignments to be proposed.

    What occurs nowhere takes no place of what does: it is the number left out that is bounded.
    """
    which = np.repeat(np.arange(len(items.seeds)), np.diff(items.bounds))
    spare = [demands(len(w), least)[1] - int(n) for w, n in zip(items.words, items.agreeing, strict=True)]
    stay = counts[which] > 0
    for at in np.lexsort((-counts[which], items.owners)).tolist():
        owner, n = int(items.owners[at]), int(items.times[at])
        if n <= spare[owner]:
            spare[owner] -= n
            stay[at] = False
    return under(items, items.seeds[which[stay]], items.owners[stay], items.times[stay])


def local_score(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the end of its part of ``words``."""
    steps = np.arange(len(words) + 1)
    row, best, end = np.zeros(len(words) + 1, dtype=np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(words == word, 2, -1), row[1:] - 1)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        at = int(new.argmax())
        if new[at] > best:
            best, end = int(new[at]), at
        row = new
    return best, end


def aligned(item: np.ndarray, words: np.ndarray, least: float) -> tuple[float, int, int]:
    """Share of the item's own score, and the bounds of the aligned words if it is enough."""
    best, end = local_score(item, words)
    if best / (2 * len(item)) < least:
        return 0.0, 0, 0
    back, length = local_score(item[::-1], words[:end][::-1])
    return best / (2 * len(item)), end - length, end


def regions(items: Items, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item and word bounds of all parts of a slice where an alignment can be."""
    row, where, which = items.hits(hashes, rows)
    many = np.diff(items.bounds)[which]
    at = np.repeat(items.bounds[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
    item, row, where = items.owners[at], np.repeat(row, many), np.repeat(where, many)
    key = row * len(items.words) + item
    order = np.lexsort((where, key))
    key, item, row, where = key[order], item[order], row[order], where[order]
    last = np.arange(len(key)) + items.agreeing[item] - 1
    there = last < len(key)
    last[~there] = 0
    end = where[last] + items.widths[item]
    there &= (key[last] == key) & (end - where <= items.reaches[item])
    key, item, row = key[there], item[there], row[there]
    low = np.maximum(rows[row], end[there] - items.spans[item])
    high = np.minimum(rows[row + 1], where[there] + items.spans[item])
    opens = np.ones(len(key), dtype=bool)
    opens[1:] = (key[1:] != key[:-1]) | (low[1:] > high[:-1])
    firsts = np.flatnonzero(opens)
    closes = np.append(firsts[1:], len(key))[: len(firsts)] - 1
    yield from zip(row[firsts].tolist(), item[firsts].tolist(), low[firsts].tolist(), high[closes].tolist(), strict=True)


def most(own: np.ndarray, words: np.ndarray) -> int:
    """No local alignment scores more: words that the item lacks take 1 each."""
    at = np.searchsorted(own, words)
    at[at == len(own)] = 0
    total = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.where(own[at] == words, 2, -1), out=total[1:])
    return int((total - np.minimum.accumulate(total)).max())


def leaks_of(items: Items, hashes: np.ndarray, rows: np.ndarray, least: float) -> dict[int, list]:
    """By row of a slice: item, score, first and last word bound of its best alignment."""
    out: dict[int, dict] = {}
    known: dict[int, np.ndarray] = {}
    for r, i, low, high in regions(items, hashes, rows):
        own = items.words[i]
        if i not in known:
            known[i] = np.unique(own)
        enough = min(least, LONG / len(own))
        if most(known[i], hashes[low:high]) / (2 * len(own)) < enough:
            continue
        score, first, last = aligned(own, hashes[low:high], enough)
        if score >= enough:
            begin = low - int(rows[r])
            held = out.setdefault(r, {}).get(i)
            if held is None or score > held[1]:
                out[r][i] = (i, score, begin + first, begin + last)
    return {r: [found[i] for i in sorted(found)] for r, found in out.items()}


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and an array of the items each holds.

    A leak is an alignment with the ``least`` share of the item's own score, or with the score
    of ``LONG`` unbroken words. An entry has the item's id, the score (0 to 1) and the bounds of the aligned words, of
    lower-cased words of letters and digits. Items that are null or have fewer than three words
    are in no document; items with equal texts are all reported.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    items = staged(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n_batches = max(1, -(-items.count() // (ITEM_BATCH // 2)))
    every = []
    for b in range(n_batches):
        some = items.where(F.pmod(F.xxhash64("row"), F.lit(n_batches)) == b).orderBy("row").toArrow()
        ids, texts = some["item_id"].to_pylist(), some["text"].combine_chunks()
        whole = items_of(ids, texts, least)
        counts = seed_counts(docs.select(docs[text].alias("text")), whole)
        every.append(rarest(whole, counts, least))
    kind = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"
    entry = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    out, names = docs, []
    for own in every:

        def make(columns: list[pa.Array], own=own) -> pa.Array:
            found: list[list] = [[] for _ in range(len(columns[0]))]
            for first, hashes, rows in lower_slices(columns[0]):
                for r, leaks in leaks_of(own, hashes, rows, least).items():
                    found[first + r] = [
                        {"item_id": own.ids[i], "score": s, "first_word": a, "last_word": z} for i, s, a, z in leaks
                    ]
            return pa.array(found, pa.list_(entry))

        after = with_column(out, [text], make, "leaks", kind)
        names.append(added(out, after))
        out = after
    if len(names) > 1:
        out = out.withColumn(names[0], F.concat(*(F.col(f"`{n}`") for n in names))).drop(*names[1:])
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    marked = with_leaks(docs, benchmark)
    name = added(docs, marked)
    return marked.where(F.size(F.col(f"`{name}`")) == 0).drop(name)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    marked = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leak = F.explode("leaks").alias("leak")
    return marked.where(F.size("leaks") > 0).select("doc_id", leak).select("doc_id", "leak.*")

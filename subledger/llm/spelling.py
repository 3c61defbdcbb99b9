"""Variants of a word's spelling: words one edit apart, and the commonest near word as the form.

Words one inserted, deleted or replaced code point apart share a prefix and a suffix that
together are as long as the longer word less one. So one half of the longer word is equal in
both, and words are grouped by their first or last half, once for their own length and once
for a word one longer. A group of more than ``GROUP`` words is split the same way again, by the
halves of what its words do not share yet, until it fits; when all but one code point is
shared, a group is no larger than the alphabet. That way no group grows with the data and none
is cut short.

Groups lie sorted in their tasks and are compared by blocks: each block of rows, as a matrix of
padded code points, meets itself and those after it that reach the same group. Common prefix plus
common suffix decide; a pair counts in the one group on the way that its common prefix takes.

Null and empty texts have no words. Every row counts, those with a repeated ``doc_id`` too; a null
``doc_id`` is written as nothing. Runs of any length are taken whole. An empty table has no words.
Ties between near words go to the smallest in code-point order. Other columns play no part.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.text import TAIL, Words, byte_table, documents, eights, lowered, same_spans, slices, word_hashes, words_of
from subledger.sources.shared_folder import staged

# Shortest word, least count, one in so many occurrences loses a code point.
LEAST_POINTS, LEAST_COUNT, ALTERED = 5, 3, 97
GROUP = 512  # words that are compared all with all
BLOCK = 64  # rows of a matrix
HELD = 1 << 17  # distinct words a task counts before it hands them on
CELLS = 1 << 22  # code points compared at once
VECTORED = 64  # bytes of a run beyond which its checksum is taken by itself

#: U+00C0 to U+00FF are 0xC3 and a byte, which ``letters`` sees as a letter.
INSIDE = byte_table(lambda b: 0x61 <= b <= 0x7A or b == 0xC3)


def _crc_table() -> np.ndarray:
    """The reversed polynomial 0xEDB88320, byte by byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def letter_runs(texts) -> tuple[np.ndarray, Words]:
    """The lower-cased bytes and the runs of letters in them."""
    low = lowered(texts.data)
    letters = low.copy()
    letters[1:][low[:-1] == 0xC3] = ord("a")
    return low, words_of(texts, letters, INSIDE)


def checksums(data: np.ndarray, words: Words, before: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run, carried on from the checksum of what stands before it."""
    sizes, state = words.ends - words.starts, before ^ np.uint32(0xFFFFFFFF)
    more = np.flatnonzero(sizes <= VECTORED)
    for k in range(VECTORED):
        more = more[sizes[more] > k]
        if not len(more):
            break
        own = state[more]
        state[more] = CRC[(own ^ data[words.starts[more] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > VECTORED).tolist():
        out[i] = zlib.crc32(data[words.starts[i] : words.ends[i]].tobytes(), int(before[i]))
    return out


def tallied(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """Distinct runs and how often each stands here; one may come twice if hashes meet."""
    sizes = ends - starts
    keys = (eights(data)[starts] & TAIL[np.minimum(sizes, 7)]) | sizes.astype(np.uint64) << np.uint64(56)
    long = sizes > 7
    keys[long] = word_hashes(data, starts[long], ends[long]) | np.uint64(1 << 63)
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    one, check = first[back], np.flatnonzero(long)
    same = np.ones(len(starts), dtype=bool)
    same[check] = sizes[one[check]] == sizes[check]
    check = check[same[check]]
    same[check] = same_spans(data, starts[one[check]], data, starts[check], sizes[check])
    counts = np.bincount(back[same], minlength=len(first))
    for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), counts.tolist(), strict=True):
        yield data[a:b].tobytes(), n
    for i in np.flatnonzero(~same).tolist():
        yield data[starts[i] : ends[i]].tobytes(), 1


def without(run: bytes, h: int) -> bytes:
    """The run without its code point h, counted round from 0."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: all words of the texts that are long and common enough."""

    def rows(held: Counter) -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                low, words = letter_runs(texts)
                before = [zlib.crc32(b":" if k is None else f"{k}:".encode()) for k in names[texts.first : texts.last]]
                found = checksums(low, words, np.repeat(np.array(before, dtype=np.uint32), np.diff(words.rows)))
                altered = found % np.uint32(ALTERED) == 0
                for i in np.flatnonzero(altered).tolist():
                    held[without(low[words.starts[i] : words.ends[i]].tobytes(), int(found[i]))] += 1
                for word, n in tallied(low, words.starts[~altered], words.ends[~altered]):
                    held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    parts = df.select(df[key], df[text]).mapInArrow(run, "word string, n long").where(F.length("word") >= LEAST_POINTS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def halves(members: DataFrame) -> DataFrame:
    """Each row twice: by the first and by the last half of what its group does not share yet.

    ``size`` is the length of a pair's longer word; all words of a group share their first
    ``lo`` and last ``hi`` code points.
    """
    half = F.expr("(size - lo - hi) div 2").cast("int")
    ways = F.explode(F.array(
        F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.col("lo").alias("lo"), (F.col("size") - F.col("lo") - half).alias("hi")),
    ))
    split = members.select("word", "n", "size", ways.alias("way")).select("word", "n", "size", "way.*")
    shared = F.xxhash64("size", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, hi)"))
    return split.withColumn("key", shared)


def grouped(words: DataFrame) -> DataFrame:
    """The words under the keys of all groups they must be compared in, none of them too large."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1))
    whole = words.select("word", "n", sizes.alias("size")).withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    members, fitting = halves(whole), []
    while True:
        large = members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("key")
        large = staged(large, "large_groups")
        if large.isEmpty():
            return _all([*fitting, members])
        open_still = F.expr("size - lo - hi > 1")
        fitting += [members.join(large, "key", "left_anti")]
        crowded = members.join(large, "key", "left_semi").select(*members.columns)
        fitting += [crowded.where(~open_still)]  # full only because two keys' hashes met
        members = staged(halves(crowded.where(open_still)), "split_groups")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Rows:
    """Sorted rows of whole groups, and their words as matrices."""

    def __init__(self, words: list[str], n: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray):
        self.words, self.n, self.size, self.lo, self.hi, self.key = words, n, size, lo, hi, key
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        width = int(lengths.max())
        flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        inside = np.arange(width) < lengths[:, None]
        self.forward = np.zeros((len(words), width), dtype=np.uint8)
        self.forward[inside] = flat
        self.backward = np.zeros_like(self.forward)
        self.backward[inside] = flat[::-1][_reversed_order(lengths)]
        self.lengths = lengths

    def block_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of block pairs that are of one group, each two rows once, a bounded number at a time."""
        rows, last = len(self.key), -(-len(self.key) // BLOCK)
        most = max(1, CELLS // (BLOCK * BLOCK))
        firsts = np.arange(last) * BLOCK
        for apart in range(last):
            begins = firsts[: last - apart]
            if apart:
                ends = begins + BLOCK - 1
                begins = begins[self.key[ends] == self.key[begins + apart * BLOCK]]
            if not len(begins):
                return
            for k in range(0, len(begins), most):
                one = begins[k : k + most, None] + np.arange(BLOCK)
                two = one + apart * BLOCK
                left, right = np.minimum(one, rows - 1), np.minimum(two, rows - 1)
                meet = (self.key[left][:, :, None] == self.key[right][:, None, :]) & (one[:, :, None] < two[:, None, :])
                meet &= (two < rows)[:, None, :]
                tile, i, j = np.nonzero(meet)
                yield left[tile, i], right[tile, j]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows whose words are one edit apart and whose pair belongs to their group."""
        found = []
        for one, two in self.block_pairs():
            alike = (self.size[one] == self.size[two]) & (self.lo[one] == self.lo[two]) & (self.hi[one] == self.hi[two])
            alike &= np.maximum(self.lengths[one], self.lengths[two]) == self.size[one]
            one, two = one[alike], two[alike]
            step = max(1, CELLS // self.forward.shape[1])
            for k in range(0, len(one), step):
                a, b = one[k : k + step], two[k : k + step]
                prefix = (self.forward[a] != self.forward[b]).argmax(axis=1)
                suffix = (self.backward[a] != self.backward[b]).argmax(axis=1)
                size = self.size[a]
                keep = (prefix + suffix >= size - 1) & (prefix >= self.lo[a]) & (prefix < size - self.hi[a])
                found.append((a[keep], b[keep]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def summary(self) -> pa.RecordBatch | None:
        """For each word with near ones here: their number, and the best of them."""
        one, two = self.near()
        if not len(one):
            return None
        here, there = np.concatenate([one, two]), np.concatenate([two, one])
        rows = np.unique(there)
        rank = np.zeros(len(self.words), dtype=np.int64)
        rank[sorted(rows.tolist(), key=self.words.__getitem__)] = np.arange(len(rows))
        order = np.lexsort((rank[there], -self.n[there], here))
        here, there = here[order], there[order]
        first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        n_near = np.diff(np.append(first, len(here)))
        mine, best = here[first].tolist(), there[first].tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.words[i] for i in mine], pa.string()),
                pa.array(n_near, pa.int64()),
                pa.array([self.words[i] for i in best], pa.string()),
                pa.array(self.n[best], pa.int64()),
            ],
            ["word", "n_near", "best", "best_n"],
        )


def _reversed_order(lengths: np.ndarray) -> np.ndarray:
    """Places in a reversed text of rows, so that the rows come in their own order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    starts = total - ends  # where each row begins in the reversed text
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def compared(members: DataFrame) -> DataFrame:
    """word, n_near, best, best_n for each group with near words."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * GROUP:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            upto = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])  # the last group may go on
            held = table.slice(upto).to_batches()
            yield from results(table.slice(0, upto))
        if held:
            yield from results(pa.Table.from_batches(held))

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table["key"].to_numpy()
        again = np.append(False, key[1:] == key[:-1])
        kept = np.flatnonzero(again | np.append(again[1:], False)) if len(key) else np.empty(0, np.int64)
        if not len(kept):
            return
        table, key = table.take(kept), key[kept]
        bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        widths = table["size"].to_numpy()
        first = 0
        for k in range(1, len(bounds)):  # whole groups, as many as fit the matrices
            following = bounds[k + 1] if k + 1 < len(bounds) else None
            if following is None or (following - bounds[first]) * int(widths[bounds[first] : following].max()) > CELLS:
                own = table.slice(bounds[first], bounds[k] - bounds[first])
                columns = [own[c].to_numpy() for c in ("n", "size", "lo", "hi", "key")]
                out = Rows(own["word"].to_pylist(), *columns).summary()
                if out is not None:
                    yield out
                first = k

    ordered = members.repartition("key").sortWithinPartitions("size", "key")
    return ordered.mapInArrow(run, "word string, n_near long, best string, best_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word, by doubling the way each round.

    A form is at least twice as common as its word, so ways are short and never lead back.
    """
    links = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while not links.where("open").isEmpty():
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = links.join(onward, F.col("root") == F.col("at"), "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        links = staged(moved, "roots")
    return links.select("word", "root")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each word with its count, near words, form and root."""
    words = staged(word_counts(df, key, text), "words")
    best: Column = F.struct((-F.col("best_n")).alias("less"), F.col("best"))
    near = compared(grouped(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    common = -F.col("best.less") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("best.best")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )
    found = staged(found, "near_words")
    roots = rooted(found.where("form is not null"))
    found = found.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir, "doc_id", "text"))

"""Words and hashes of whole Arrow string columns, by array arithmetic over their bytes.

Equal words always get equal hashes. ``word_hashes`` chains eight bytes at a time through a
mixing step and takes a seed, so two seeds give two independent hashes; ``span_hashes`` are
64-bit polynomials, which some long words of two letters can be made to share. Where a
collision could change a result, callers compare the bytes, or use ``word_hashes``.
"""

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
U64 = np.uint64


def _odd(seed: int) -> np.uint64:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, dtype=np.uint64) | U64(1)


BASE, GRAM_BASE, SECOND_BASE = _odd(11), _odd(12), _odd(13)
BYTE_VALUES = np.random.default_rng(14).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**0 … base**(n-1)`` modulo 2^64 and their inverses."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(base), -1, 1 << 64))
        both = []
        for factor in (base, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        if size > 1 << 23:
            return both[0], both[1]
        known = _powers[int(base)] = (both[0], both[1])
    return known


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of every bit over all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base=BASE) -> np.ndarray:
    """A hash of each ``values[start:end]``; spans ascend, and are handled a few MB at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        upto = max(done + 1, int(np.searchsorted(starts, low + (1 << 19))))
        high = int(ends[done:upto].max())
        part = values[low:high]
        part = BYTE_VALUES[part] if part.dtype == np.uint8 else part
        power, inverse = powers(base, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(part * power[: high - low], out=sums[1:])
        s, e = starts[done:upto] - low, ends[done:upto] - low
        out[done:upto] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        done = upto
    return out


#: How many of eight bytes count, as a mask by their number.
TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
CHAINED = 64  # bytes of a word beyond which a digest of the whole word is taken


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each ``data[start:end]``; words of up to eight bytes and equal length never collide."""
    at, sizes = eights(data), ends - starts
    key = _odd(100 + seed)
    out = mixed(mixed(sizes.astype(np.uint64) ^ key) ^ (at[starts] & TAIL[np.minimum(sizes, 8)]))
    more, done = np.flatnonzero(sizes > 8), 8
    while len(more) and done < CHAINED:
        part = at[starts[more] + done] & TAIL[np.minimum(sizes[more] - done, 8)]
        out[more] = mixed((out[more] * key) ^ part)
        done += 8
        more = more[sizes[more] > done]
    for i in more.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.tobytes())
        out[i] = np.frombuffer(digest.digest(), dtype=np.uint64)[0]
    return out


def same_spans(one: np.ndarray, starts: np.ndarray, two: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``one[start:start + size]`` and ``two[other:other + size]`` hold the same bytes."""
    left, right = eights(one), eights(two)
    same = ((left[starts] ^ right[others]) & TAIL[np.minimum(sizes, 8)]) == 0
    more, done = np.flatnonzero(same & (sizes > 8)), 8
    while len(more) and done < CHAINED:
        mask = TAIL[np.minimum(sizes[more] - done, 8)]
        same[more] = ((left[starts[more] + done] ^ right[others[more] + done]) & mask) == 0
        done += 8
        more = more[same[more] & (sizes[more] > done)]
    for i in more.tolist():
        a, b, n = starts[i], others[i], sizes[i]
        same[i] = np.array_equal(one[a : a + n], two[b : b + n])
    return same


class Texts(NamedTuple):
    """Rows ``first`` to ``last`` of a batch, as one run of UTF-8 bytes."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column, null as empty, a few MB at a time; a longer text comes alone."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        last = min(last, n)
        low, high = int(bounds[first]), int(bounds[last])
        yield Texts(first, last, data[low:high], bounds[first : last + 1] - low)
        first = last


class Words(NamedTuple):
    """Words as byte spans; those of row i are ``rows[i]:rows[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def byte_table(inside) -> np.ndarray:
    return np.fromiter((inside(b) for b in range(256)), dtype=bool, count=256)


#: Words of the contracts: everything but space and tab to carriage return.
NON_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of lower-cased text: digits, a-z and everything beyond ASCII.
ALPHANUMERIC = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words_of(texts: Texts, data: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of ``inside`` bytes; no run crosses from one text to the next."""
    n = len(data)
    within = np.zeros(n + 1, dtype=bool)
    within[:n] = inside[data]
    opens, closes = within[:n].copy(), within[:n].copy()
    opens[1:] &= ~within[: n - 1] if n else opens[1:]
    closes &= ~within[1:]
    edges = np.unique(texts.bounds)
    edges = edges[edges < n]
    opens[edges] = within[edges]
    edges = edges[edges > 0] - 1
    closes[edges] = within[edges]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


def grams(hashes: np.ndarray, n: int, base=GRAM_BASE) -> np.ndarray:
    """A hash of every run of n neighbours, by its first position."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = hashes[:count].copy()
    for k in range(1, n):
        total = total * base + hashes[k : k + count]
    return mixed(total)


def small_batches(spark: SparkSession) -> None:
    """Few rows an Arrow batch, since a row holds a whole document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rows_a_batch(spark: SparkSession, n: int):
    """At most n rows an Arrow batch for the jobs that run inside the block."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def rows_a_read(spark: SparkSession, n: int):
    """At most n rows at once from a Parquet file for the jobs that run inside the block."""
    return setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(n))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)

"""What each of five text filters removes, in every order they could be applied in.

One pass over the bytes of the texts drives a table: a byte's class, after the class of the byte
before it, says whether a word begins, and whether the byte is a capital, a symbol or the first
of a code point. Each word's span goes into an open hash table under its row and hash; a word
that meets a holder of its place is the same only if row, length and bytes agree, else it
tries the next place. So a text's distinct words are those that took a place.

What a document fails is five bits. Documents of the same part, bits and labels are counted,
and all 120 orders are worked out from those counts, at most 128 for a part.

Whether a smaller document has the same text is found by a SHA-256 digest of the text: counts
per digest are summed before they meet, so very many copies of one text are few rows.

Null texts are empty, a null ``source`` is the part of the empty string. Every row counts, those
with a repeated ``doc_id`` too: they fail E if a smaller doc_id has their text. A row without
``doc_id`` never fails E and is no smaller document. Of several label rows of a document the
largest quality and toxic count. An empty table has no rows. Other columns play no part.
"""

import hashlib
from functools import reduce
from itertools import permutations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subledger.llm.text import NON_SPACE, byte_table, documents, same_spans, slices, word_hashes

# The filters' letters, limits and symbols.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"

#: What a byte is, as bits, and the table that adds "begins a word" from the class before it.
INSIDE, CAPITAL, SYMBOL, POINT, BEGINS = 1, 2, 4, 8, 16
CLASS = (
    NON_SPACE * np.uint8(INSIDE)
    + byte_table(lambda b: 0x41 <= b <= 0x5A) * np.uint8(CAPITAL)
    + byte_table(lambda b: b in SYMBOLS) * np.uint8(SYMBOL)
    + byte_table(lambda b: b & 0xC0 != 0x80) * np.uint8(POINT)
).astype(np.uint8)
STEP = np.array([[now | (BEGINS if now & INSIDE and not before else 0) for now in range(16)] for before in (0, 1)], dtype=np.uint8)


def emitted(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The table's output for each byte; every text starts outside of words."""
    classes = CLASS[data]
    before = np.zeros(len(data), dtype=np.uint8)
    before[1:] = classes[:-1] & INSIDE
    before[bounds[bounds < len(data)]] = 0
    return STEP[before, classes]


def totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, bounds))


def took_place(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word whether it is the one of its row and bytes that stands in the hash table."""
    n = len(starts)
    sizes, slots = ends - starts, 1 << max(4, int(2 * n).bit_length())
    home = word_hashes(data, starts, ends) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = ((home ^ (home >> np.uint64(29))) & np.uint64(slots - 1)).astype(np.int64)
    holder, stands = np.full(slots, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    pending = np.arange(n)
    while len(pending):
        own = slot[pending]
        free = holder[own] < 0
        holder[own[free]] = pending[free]
        held = holder[own]
        stands[held[held == pending]] = True
        alike = (rows[held] == rows[pending]) & (sizes[held] == sizes[pending])
        alike[alike] = same_spans(data, starts[held[alike]], data, starts[pending[alike]], sizes[pending[alike]])
        pending = pending[~alike]
        slot[pending] = (slot[pending] + 1) & (slots - 1)
    return stands


def measured(texts) -> tuple[np.ndarray, ...]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    data, bounds = texts.data, texts.bounds
    out = emitted(data, bounds)
    starts = np.flatnonzero(out & BEGINS)
    inside = (out & INSIDE) > 0
    ends = inside.copy()  # the last byte of a word: what follows is outside, or another text
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds <= len(data))] - 1
    ends[edges] = inside[edges]
    last = np.flatnonzero(ends)
    edges = np.searchsorted(starts, bounds)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(edges))
    stands = took_place(data, starts, last + 1, rows)
    return (
        np.diff(edges),
        np.bincount(rows[stands], minlength=len(bounds) - 1),
        totals(out & CAPITAL, bounds),
        totals(out & POINT, bounds),
        totals(out & SYMBOL, bounds),
    )


def failures(texts) -> np.ndarray:
    """Bits 0 to 3 for each text: which of A to D it fails."""
    words, distinct, capitals, points, symbols = measured(texts)
    return (
        (words < LEAST_WORDS) * 1
        + (100 * distinct < DISTINCT_PERCENT * words) * 2
        + (100 * capitals > CAPITAL_PERCENT * points) * 4
        + (symbols > 0) * 8
    ).astype(np.int32)


def screened(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Each row's key, part, failed bits of A to D, and the digest of its text."""

    def run(batches):
        for batch in batches:
            bits, digests = [], []
            for texts in slices(batch.column(2)):
                bits.append(failures(texts))
                raw, edges = memoryview(texts.data.tobytes()), texts.bounds.tolist()
                digests += [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            flat = np.concatenate(bits) if bits else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flat), pa.array(digests, pa.binary())],
                ["doc", "part", "bits", "digest"],
            )

    own = df.select(df[key].cast("long"), F.coalesce(df[part], F.lit("")), df[text])
    return own.mapInArrow(run, "doc long, part string, bits int, digest binary")


def failing(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Documents by part, all five failed bits and labels: part, bits, n, good, toxic (counts)."""
    same = ["digest", "part", "bits"]
    rows = screened(df, key, text, part).groupBy("doc", *same).agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        (F.max("quality") == 1).cast("long").alias("is_good"), (F.max("toxic") == 1).cast("long").alias("is_toxic")
    )
    label = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("is_good", "is_toxic")]
    rows = rows.join(known, "doc", "left").select("doc", *same, "n", *label)
    # Of one text: its rows by part and label, and those of its smallest document.
    by_label = rows.groupBy(*same, "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.min("doc").alias("least"), F.min_by("n", "doc").alias("n_least"),
        F.sum(F.when(F.col("doc").isNull(), F.col("n"))).alias("n_nameless"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.coalesce(F.when(F.col("least") == least, F.col("n_least")), F.lit(0)) + F.coalesce("n_nameless", F.lit(0))
    split = by_label.withColumn("first", first).select(
        "part", "is_good", "is_toxic",
        F.explode(F.array(
            F.struct("bits", F.col("first").alias("n")),
            F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("first")).alias("n")),
        )).alias("of"),
    )
    return split.groupBy("part", F.col("of.bits").alias("bits")).agg(
        F.sum("of.n").alias("n"),
        F.sum(F.col("of.n") * F.col("is_good")).alias("good"),
        F.sum(F.col("of.n") * F.col("is_toxic")).alias("toxic"),
    )


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    masks = range(1 << len(FILTERS))
    counts = failing(df, labels, key, text, part)

    def by_bits(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("bits") == m, F.col(name))), F.lit(0)) for m in masks]).alias(name)

    parts = counts.groupBy("part").agg(*[by_bits(name) for name in ("n", "good", "toxic")])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)")
    earlier = reduce(
        add,
        [F.when(F.locate(f, F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)],
    )
    steps = steps.withColumns({"own": own, "earlier": earlier})

    def total(name: str, wanted) -> Column:
        """The counts of the bits for which ``wanted`` holds."""
        return F.aggregate(
            F.transform(name, lambda n, m: F.when(wanted(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n
        )

    def has(m: Column, bits: str) -> Column:
        return m.bitwiseAND(F.col(bits)) != 0

    removed = lambda m: has(m, "own") & ~has(m, "earlier")
    # Of the orders, one in so many has a given failed filter of a document first.
    share = F.array(*[F.lit(0 if not m else 120 // m.bit_count()) for m in masks])
    shares = F.transform("n", lambda n, m: F.when(has(m, "own"), n * F.element_at(share, m + 1)).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~has(m, "own") & ~has(m, "earlier")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: has(m, "own") & has(m, "earlier")).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, n: a + n).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(documents(spark, sf_dir, "doc_id", "text", "source"), labels)


OP11_SQL = r"""
with texts as (
  select row_number() over () as row_id, doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
least as (select body, min(doc_id) as least_id from texts group by body),
known as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
failed as (
  select t.row_id, t.part, k.quality = 1 as good, k.toxic = 1 as toxic,
         [len(words) < 50,
          100 * len(list_distinct(words)) < 65 * len(words),
          100 * len(regexp_replace(t.body, '[^A-Z]', '', 'g')) > 5 * len(t.body),
          regexp_matches(t.body, '[#$%&*|]'),
          coalesce(t.doc_id > l.least_id, false)] as fails
  from texts t join least l on t.body = l.body left join known k on t.doc_id = k.doc_id
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.letter not in (b.letter, c.letter, d.letter, e.letter) and b.letter not in (c.letter, d.letter, e.letter)
    and c.letter not in (d.letter, e.letter) and d.letter <> e.letter
),
patterns as (
  select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
  from failed group by part, fails
),
steps as (
  select filter_order, step, ascii(filter_order[step]) - 64 as own,
         [ascii(x) - 64 for x in string_split(filter_order[1:step - 1], '') if x <> ''] as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)
),
met as (
  select p.part, s.filter_order, cast(s.step as int) as step, s.own, p.n, p.n_good, p.n_toxic, p.fails[s.own] as hit,
         len([x for x in s.earlier if p.fails[x]]) > 0 as gone,
         len([x for x in p.fails if x]) as n_fails
  from patterns p, steps s
),
told as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (not hit and not gone), 0) as kept,
         coalesce(sum(n) filter (hit and not gone), 0) as removed,
         coalesce(sum(n) filter (hit and gone), 0) as redundant,
         coalesce(sum(n) filter (hit and n_fails = 1), 0) as unique_fails,
         coalesce(sum(n_good) filter (hit and not gone), 0) as good_lost,
         coalesce(sum(n_toxic) filter (hit and not gone), 0) as toxic_lost
  from met group by part, filter_order, step, own
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from told
"""

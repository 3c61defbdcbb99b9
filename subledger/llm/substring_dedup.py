"""Repeated passages by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Its anchor is the run of
``ANCHOR`` words in it with the least hash, so equal windows have equal anchors at equal
places. Anchors are the first, short prefixes: two windows can only be equal if their
anchors are, and an anchor that one document alone holds is dropped with all its windows.

Neighbouring windows with one anchor place form a run. Runs with equal words are one
context; all but the copies in its least document are repeats at once. What is left is
contexts that share an anchor but differ somewhere. They split into groups of a size that
fits in memory: by anchor where few contexts share it, and where many do by the longest
prefix, the whole window, at which equal windows meet in one row per task already. In a
group the windows' suffixes are named by their first 2, 4, … 32, ``WINDOW`` words; equal
names are the tree's nodes of that depth, and the deepest are the repeats.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.text import (
    GRAM_BASE,
    NON_SPACE,
    SECOND_BASE,
    documents,
    grams,
    mixed,
    slices,
    span_hashes,
    word_hashes,
    words_of,
)
from subledger.sources.shared_folder import staged

WINDOW, ANCHOR = 50, 8
SECOND = 1  # seed of the words' second hash
FEW = 64  # contexts of one anchor that stay in one group
GROUP_WORDS = 1 << 20
KEY_BROADCAST = 1 << 20  # document keys that may be sent to every task
PLACE_BITS = 26


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, hash and text of each row; a null key becomes the largest one."""
    last = F.lit((1 << 63) - 1)
    return df.select(
        df[key].alias("key"),
        F.coalesce(df[key].cast("long"), last).alias("doc"),
        F.xxhash64(df[text]).alias("version"),
        df[text].alias("text"),
    )


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbours is, the first of equal ones."""
    most = 1 << PLACE_BITS
    if len(values) > most:  # pieces overlap, so that each window is whole in one
        begins = range(0, len(values) - width + 1, most - width + 1)
        return np.concatenate([least_places(values[k : k + most], width) + k for k in begins])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & low).astype(np.int64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def runs(df: DataFrame) -> DataFrame:
    """Runs of windows: anchor, hashes of its words, document, first window, windows."""

    def run(batches):
        for batch in batches:
            docs, versions = (batch.column(i).to_numpy() for i in (0, 1))
            for texts in slices(batch.column(2)):
                words = words_of(texts, texts.data, NON_SPACE)
                hashes = word_hashes(texts.data, words.starts, words.ends)
                if len(hashes) < WINDOW:
                    continue
                others = word_hashes(texts.data, words.starts, words.ends, SECOND)
                anchors = grams(hashes, ANCHOR)
                places = least_places(anchors, WINDOW - ANCHOR + 1)
                ends = np.repeat(words.rows[1:], np.diff(words.rows))[: len(places)]
                whole = np.arange(len(places)) + WINDOW <= ends
                places = np.where(whole, places, -1)
                opens = np.flatnonzero(whole & (places != np.append(-2, places[:-1])))
                if not len(opens):
                    continue
                shut = whole & (places != np.append(places[1:], -2))
                n = np.flatnonzero(shut) - opens + 1
                upto, place = opens + n + WINDOW - 1, places[opens]
                offset = (place - opens).astype(np.uint64)
                row = np.searchsorted(words.rows, opens, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(anchors[place]),
                        signed(mixed(span_hashes(hashes, opens, upto, GRAM_BASE) + offset)),
                        signed(mixed(span_hashes(others, opens, upto, SECOND_BASE) + offset)),
                        pa.array(docs[texts.first + row]),
                        pa.array(versions[texts.first + row]),
                        pa.array((opens - words.rows[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["anchor", "one", "two", "doc", "version", "at", "n"],
                )

    schema = "anchor long, one long, two long, doc long, version long, at int, n int"
    return df.select("doc", "version", "text").mapInArrow(run, schema)


def fragments(needed: DataFrame, few: bool) -> DataFrame:
    """The words of needed runs as hashes: whole runs, or each window's two hashes."""

    def run(batches):
        for batch in batches:
            docs, versions, needs = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for texts in slices(batch.column(2)):
                words = words_of(texts, texts.data, NON_SPACE)
                hashes = word_hashes(texts.data, words.starts, words.ends)
                others = hashes if few else word_hashes(texts.data, words.starts, words.ends, SECOND)
                out = []
                for k in range(texts.first, texts.last):
                    row = slice(words.rows[k - texts.first], words.rows[k - texts.first + 1])
                    own, other = hashes[row], others[row]
                    if few:
                        for need in needs[k]:
                            span = own[need["at"] : need["at"] + need["n"] + WINDOW - 1]
                            out.append((need["anchor"], docs[k], versions[k], need["at"], span.tobytes()))
                    else:
                        begins = np.unique(
                            np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in needs[k]])
                        )
                        one = span_hashes(own, begins, begins + WINDOW, GRAM_BASE).view(np.int64)
                        two = span_hashes(other, begins, begins + WINDOW, SECOND_BASE).view(np.int64)
                        for a, b, c in zip(one.tolist(), two.tolist(), begins.tolist(), strict=True):
                            out.append((a, b, docs[k], versions[k], c))
                if out:
                    columns = zip(*out, strict=True)
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    if few:
        schema = "anchor long, doc long, version long, at int, words binary"
        types = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
    else:
        schema = "one long, two long, doc long, version long, at int"
        types = [pa.int64()] * 4 + [pa.int32()]
    names = [part.split()[0] for part in schema.split(", ")]
    return needed.select("doc", "version", "text", "needs").mapInArrow(run, schema)


def named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]


def deep_nodes(words: np.ndarray, begins: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix its node at ``depth`` words; every suffix has that many words left."""
    names = np.unique(words, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span * 2 <= depth:
        names = named(names[:-span], names[span:])
        span *= 2
    rest = depth - span
    return named(names[begins], names[begins + rest]) if rest else names[begins]


def repeats_in_group(group: pa.Table) -> pa.Table:
    """Windows of a group that a smaller document holds too, as ranges of words."""
    spans = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["words"]]
    sizes = np.array([len(s) for s in spans])
    firsts = np.cumsum(sizes) - sizes
    counts = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(spans)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    nodes = deep_nodes(np.concatenate(spans), firsts[owner] + inner)
    docs = group["doc"].to_numpy()[owner]
    least = np.full(nodes.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, nodes, docs)
    again = docs > least[nodes]
    opens = np.flatnonzero(again & ~np.append(False, again[:-1] & (owner[1:] == owner[:-1])))
    shuts = np.flatnonzero(again & ~np.append(again[1:] & (owner[1:] == owner[:-1]), False))
    own = owner[opens]
    return pa.table(
        {
            "doc": group["doc"].to_numpy()[own],
            "version": group["version"].to_numpy()[own],
            "at": pa.array(group["at"].to_numpy()[own] + inner[opens], pa.int32()),
            "n": pa.array(shuts - opens + 1, pa.int32()),
        }
    )


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Ranges of windows (doc, version, at, n) that a smaller document holds too."""
    spark = docs.sparkSession
    every = runs(docs)
    context = ["anchor", "one", "two"]
    shared = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = staged(shared.where("low < high").select("anchor"), "anchors")
    found = staged(every.join(shared, "anchor"), "runs")
    least = found.groupBy(*context).agg(F.min("doc").alias("least"))
    least = staged(least, "contexts")
    sharing = staged(least.groupBy("anchor").agg(F.count("*").alias("contexts")), "sharing")
    least = staged(least.join(sharing, "anchor"), "sized_contexts")
    found = found.join(least, context).select("doc", "version", "at", "n", "anchor", "least", "contexts")
    found = staged(found, "runs_in_context")
    ranges = found.where("doc > least").select("doc", "version", "at", "n")

    needs = found.where("doc = least and contexts > 1")
    parts = [ranges]
    for few in (True, False):
        some = needs.where(F.col("contexts") <= FEW if few else F.col("contexts") > FEW)
        wanted = some.groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("needs"))
        wanted = staged(wanted, "needs")
        keys = wanted.select("doc", "version")
        if keys.count() <= KEY_BROADCAST:  # spares the other documents a shuffle
            keys = F.broadcast(keys)
        text = docs.join(keys, ["doc", "version"], "left_semi").join(wanted, ["doc", "version"])
        cut = fragments(text.dropDuplicates(["doc", "version"]), few)
        if few:
            cut = staged(cut, "fragments")
            size = cut.agg(F.sum(F.length("words"))).first()[0] or 0
            least_groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
            n = max(least_groups, -(-size // (8 * GROUP_WORDS)))
            grouped = cut.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("group")
            schema = "doc long, version long, at int, n int"
            parts.append(grouped.applyInArrow(lambda table: repeats_in_group(table), schema))
        else:
            cut = staged(cut, "windows")
            nodes = cut.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
            nodes = staged(nodes.where("low < high").drop("high"), "nodes")
            again = cut.join(nodes, ["one", "two"]).where("doc > low")
            parts.append(again.select("doc", "version", "at", F.lit(1).alias("n")))
    return staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "ranges")


def kept_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, and kept_text, the words left joined by one space.

    A word goes if it lies in a window that begins in a row with a smaller key too. Windows
    are those of the input. Null texts have no words; rows with equal keys leave each other's
    words alone, and a null key counts as larger than any other.
    """
    docs = keyed(df, key, text)
    ranges = repeated_ranges(docs).groupBy("doc", "version")
    ranges = ranges.agg(F.collect_list(F.struct("at", "n")).alias("ranges"))

    def run(batches):
        for batch in batches:
            ranges, out = batch.column(2).to_pylist(), []
            for texts in slices(batch.column(1)):
                words = words_of(texts, texts.data, NON_SPACE)
                raw = texts.data.tobytes()
                for k in range(texts.first, texts.last):
                    first, last = words.rows[k - texts.first], words.rows[k - texts.first + 1]
                    own = ranges[k] or ()
                    change = np.zeros(last - first + 1, dtype=np.int64)
                    np.add.at(change, [r["at"] for r in own], 1)
                    np.add.at(change, [r["at"] + r["n"] + WINDOW - 1 for r in own], -1)
                    stay = np.flatnonzero(np.cumsum(change)[:-1] == 0) + first
                    starts, ends = words.starts[stay].tolist(), words.ends[stay].tolist()
                    kept = b" ".join([raw[s:e] for s, e in zip(starts, ends, strict=True)])
                    out.append((last - first, last - first - len(stay), kept.decode()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", "n_words", "n_removed", "kept_text"])

    joined = docs.join(ranges, ["doc", "version"], "left").select("key", "text", "ranges")
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_removed long, kept_text string"
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_words(documents(spark, sf_dir, "doc_id", "text"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_words", "n_removed", digest)


OP2_SQL = r"""
with split as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                               lambda w: w <> '') as words
    from documents
),
windows as (
    select doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') as content
    from split, unnest(generate_series(1, len(words) - 49)) as t(i)
    where len(words) >= 50
),
repeated as (
    select doc_id, i from (
        select doc_id, i, min(doc_id) over (partition by content) as least from windows
    ) where doc_id > least
),
gone as (
    select distinct doc_id, i + k as place from repeated, unnest(generate_series(0, 49)) as t(k)
),
counts as (select doc_id, count(*) as n, list(place) as places from gone group by doc_id)
select doc_id, len(words) as n_words, coalesce(n, 0) as n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda w, i: places is null or not list_contains(places, i)), ' '), '')) as kept_sha256
from split left join counts using (doc_id)
"""

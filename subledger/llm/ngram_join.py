"""Documents whose sets of word n-grams overlap, by rare-first prefix filtering.

Two sets can only reach the threshold if each has enough n-grams in common with the other,
so a document with too many n-grams that no other document holds is out at once. To find
them every n-gram is counted: tasks send each n-gram of a batch of documents once, in hash
buckets; a bucket tells the batches which of theirs occur elsewhere.

What stays is folded to one row per distinct set. Its n-grams are counted again, ordered from
rare to frequent, and only a prefix joins: sets that reach the threshold share an n-gram of
both prefixes. Candidates pass filters on their lengths, on the place of the shared n-gram,
on parity bits of the sets and on the suffixes, and each remaining pair is verified once, on
the whole sets.

A frequent n-gram does not pair all its sets. First one of them meets the others. What is
linked then is one component, and pairs within it need no verification, as only the
components are asked for. In further rounds a few more sets of each n-gram that still spans
components meet those of other components. As soon as the pairs that a set outside of its
n-gram's largest component can form are few for the number of n-grams (or the rounds are
over), those are tried at once. No link between different components is left out. The sets of
an n-gram of many sets then meet by bands of length, and there in blocks of a bounded number
of sets, each a join key of its own.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.components import components
from subledger.llm.substring_dedup import KEY_BROADCAST
from subledger.llm.text import (
    NON_SPACE,
    SECOND_BASE,
    documents,
    grams,
    lowered,
    mixed,
    slices,
    span_hashes,
    word_hashes,
    words_of,
)
from subledger.sources.shared_folder import staged

N, PERCENT = 5, 80
SEVERAL = 0xFFFF  # an n-gram of several documents of its batch
PAIRS_PER_ENTRY = 2  # pairs across components are tried at once if they are this few
TURNS, STARS = 2, 8  # rounds after the first, sets of an n-gram that meet all others in one
BLOCK = 1024  # about so many sets of either side meet under one key of the last step
BITS = 512
BUCKET_BYTES = 32 << 20  # text whose n-grams one task holds at a time, about
ENTRY = ("name", "n", "place", "label", "bits")


def shingled(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each text's begin."""
    low = lowered(texts.data)
    words = words_of(texts, low, NON_SPACE)
    hashes = word_hashes(low, words.starts, words.ends)
    every = grams(hashes, n)
    counts = np.diff(words.rows)
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(words.rows[1:], counts) - np.arange(len(row))
    full = left >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = span_hashes(hashes, words.rows[short], words.rows[short + 1], SECOND_BASE)
    else:
        whole = np.empty(0, np.uint64)
    rows = np.concatenate([row[full], short])
    values = np.concatenate([every[full[: len(every)]], whole])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sums of ``values[bounds[i]:bounds[i + 1]]``."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _identity(values, bounds) -> list[bytes]:
    """Sixteen bytes that stand for each set, whatever the order of its members."""
    one = summed(mixed(values), bounds)
    two = summed(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    return [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)]


def _emit(df: DataFrame, buckets: int, n: int) -> DataFrame:
    """Per batch a row that lists its documents, and rows with its n-grams by bucket."""

    def run(batches):
        for seq, batch in enumerate(batches):
            number = (TaskContext.get().partitionId() << 32) | seq
            names, sizes, sets, owners, values = [], [], [], [], []
            for texts in slices(batch.column(2)):
                own, bounds = shingled(texts, n)
                names += _identity(own, bounds)
                sizes += np.diff(bounds).tolist()
                owners.append(np.repeat(np.arange(texts.first, texts.last), np.diff(bounds)))
                values.append(own)
            if not names:
                continue
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            new = np.ones(len(values), dtype=bool)
            new[1:] = values[1:] != values[:-1]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(values)))
            repeated = np.repeat(times > 1, times)
            known = np.bincount(owners[repeated], minlength=len(names))
            who = np.where(times > 1, SEVERAL, owners[first]).astype(np.uint16)
            values = values[first]
            bucket = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, who, key = bucket[order], who[order], values.astype(np.uint32)[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            keys, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            listed = [
                {"doc": k, "version": v, "n": m, "name": s, "shared": int(c)}
                for k, v, m, s, c in zip(keys, versions, sizes, names, known, strict=True)
            ]
            # batches of a partition count up by one: spread their lists over all buckets
            place = int(mixed(np.array([number], dtype=np.uint64))[0] % np.uint64(buckets))
            rows = [(place, number, None, None, listed)]
            rows += [
                (b, number, key[cuts[b] : cuts[b + 1]].tobytes(), who[cuts[b] : cuts[b + 1]].tobytes(), None)
                for b in np.flatnonzero(np.diff(cuts)).tolist()
            ]
            columns = zip(*rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "batch", "grams", "who", "docs"])

    doc = pa.struct(
        [("doc", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("name", pa.binary()), ("shared", pa.int64())]
    )
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(doc)]
    schema = (
        "bucket long, batch long, grams binary, who binary, "
        "docs array<struct<doc:long,version:long,n:long,name:binary,shared:long>>"
    )
    return df.select("doc", "version", "text").mapInArrow(run, schema)


def _shared_in_bucket(table: pa.Table) -> pa.Table:
    """For each batch how many n-grams of each of its documents occur in other batches."""
    lists = table.filter(table["docs"].is_valid())
    rest = table.filter(table["grams"].is_valid())
    grams_ = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in rest["grams"]]
    who = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in rest["who"]]
    batches, counts = [], []
    if grams_:
        every = np.concatenate(grams_)
        names, times = np.unique(every, return_counts=True)
        twice = names[times > 1]
        for number, own, docs in zip(rest["batch"].to_pylist(), grams_, who, strict=True):
            if not len(twice):
                break
            at = np.searchsorted(twice, own)
            at[at == len(twice)] = 0
            docs = docs[(twice[at] == own) & (docs != SEVERAL)]
            if len(docs):
                batches.append(number)
                counts.append(np.bincount(docs).astype(np.uint32).tobytes())
    return pa.table(
        {
            "batch": pa.concat_arrays([*lists["batch"].chunks, pa.array(batches, pa.int64())]),
            "counts": pa.array([None] * len(lists) + counts, pa.binary()),
            "docs": pa.concat_arrays([*lists["docs"].chunks, pa.nulls(len(counts), lists["docs"].type)]),
        }
    )


def _shared_in_batch(table: pa.Table) -> pa.Table:
    """The documents of one batch with the number of their n-grams that others hold too."""
    docs = next(x.as_py() for x in table["docs"] if x.is_valid)
    total = np.array([d["shared"] for d in docs])
    for counts in table["counts"]:
        if counts.is_valid:
            own = np.frombuffer(counts.as_buffer(), dtype=np.uint32)
            total[: len(own)] += own
    out = {name: [d[name] for d in docs] for name in ("doc", "version", "n", "name")}
    return pa.table(out | {"shared": total}, schema=pa.schema(
        [("doc", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("name", pa.binary()), ("shared", pa.int64())]
    ))


def _sets(df: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(1)):
                values, bounds = shingled(texts, n)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                part = batch.column(0).slice(texts.first, texts.last - texts.first)
                bits = parities(values, bounds)
                yield pa.RecordBatch.from_arrays([part, lists, bits], ["name", "grams", "bits"])

    return df.select("name", "text").mapInArrow(run, "name binary, grams array<long>, bits array<long>")


def parities(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set ``BITS`` bits, whether an odd number of its members falls on them.

    Two sets differ in at least as many members as in bits.
    """
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    at = row * BITS + (mixed(values) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=n * BITS).astype(np.uint8) & 1
    packed = np.packbits(odd).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (BITS // 64), pa.int32()), pa.array(packed))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """At least so many members of two ascending arrays are not shared.

    The middle member of ``b`` cuts both; members on different sides cannot be equal.
    """
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    middle = len(b) // 2
    low = int(np.searchsorted(a, b[middle]))
    found = low < len(a) and a[low] == b[middle]
    return (
        suffix_bound(a[:low], b[:middle], depth - 1)
        + suffix_bound(a[low + found :], b[middle + 1 :], depth - 1)
        + (not found)
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold, decided on the whole sets."""
    if pairs.count() * 16 <= KEY_BROADCAST:  # spares the sets of no pair a shuffle
        named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        sets = sets.join(F.broadcast(named), "name", "left_semi")
    with_a = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("of_a")), "a")
    both = with_a.join(sets.select(F.col("name").alias("b"), F.col("grams").alias("of_b")), "b")

    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (a, b))  # ascending
                least = -(-percent * (len(a) + len(b)) // (100 + percent))
                if len(a) + len(b) - 2 * least < suffix_bound(a, b, 3):
                    ok.append(False)
                    continue
                ok.append(len(np.intersect1d(a, b, assume_unique=True)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (gram, name, n, place) of each set's prefix that other sets hold too."""
    each = sets.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = staged(each.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1"), "gram_counts")
    shared = each.join(counts, "gram").groupBy("name", "n")
    shared = shared.agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("shared"))
    # n-grams of one set alone come first: they are the rarest.
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = F.slice("shared", 1, F.greatest(length - alone, F.lit(0)))
    entries = shared.select("name", "n", alone.alias("alone"), F.posexplode(prefix).alias("at", "entry"))
    entries = entries.select("entry.gram", "name", "n", (F.col("alone") + F.col("at")).alias("place"))
    return entries.join(sets.select("name", "bits"), "name")


def _candidates(left: DataFrame, right: DataFrame, percent: int, on: tuple[str, ...] = ("gram",)) -> DataFrame:
    """Pairs of entries of one n-gram (and block) that the length, place and bit filters leave, each once."""
    a = left.select(*on, *(F.col(c).alias(f"{c}_a") for c in ENTRY))
    b = right.select(*on, *(F.col(c).alias(f"{c}_b") for c in ENTRY))
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITS // 64)), F.lit(0))
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (
        # the shared n-gram and all that can follow it on the shorter side
        F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (100 + percent)
        >= (F.col("n_a") + F.col("n_b")) * percent
    ) & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    pairs = a.join(b, list(on)).where((F.col("label_a") != F.col("label_b")) & (F.col("name_a") != F.col("name_b")) & fits)
    return pairs.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct()


def _heads(marked: DataFrame, turn: int) -> DataFrame:
    """Of each n-gram whose sets are in several components some sets, chosen by hash."""
    hashed = [F.xxhash64("name", F.lit(turn * 100 + k)).alias("hash") for k in range(1 if turn == 0 else STARS)]
    entry = [F.col(c) for c in ENTRY]
    chosen = [F.min(F.struct(h, *entry)).alias(f"head{k}") for k, h in enumerate(hashed)]
    found = marked.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), *chosen)
    found = found.where("low < high")
    some = F.array_distinct(F.transform(F.array(*(f"head{k}" for k in range(len(chosen)))), lambda h: h.dropFields("hash")))
    return found.select("gram", F.explode(some).alias("head")).select("gram", "head.*")


def _outsiders(marked: DataFrame) -> DataFrame:
    """n-grams in several components: their sets, and those outside the largest component."""
    parts = marked.groupBy("gram", "label").agg(F.count("*").alias("sets"))
    found = parts.groupBy("gram").agg(
        F.sum("sets").alias("sets"), F.max(F.struct("sets", "label")).alias("largest")
    )
    return found.where("sets > largest.sets").select(
        "gram", "sets", (F.col("sets") - F.col("largest.sets")).alias("outside"), F.col("largest.label").alias("main")
    )


def _in_blocks(entries: DataFrame, percent: int, outside: bool) -> DataFrame:
    """Entries of the open n-grams under the bands and blocks in which they meet the others.

    Each set outside the main component meets every set of a length that may fit, once: it goes
    to the neighbouring bands too, and to one row of blocks, the others to one column.
    """
    width = max(math.log(100 / percent) * 1.001, 1e-3)  # lengths that fit are at most one band apart
    band = F.floor(F.log("n") / width)
    wide = F.array(band - 1, band, band + 1) if outside else F.array(band)
    bands = F.when(F.col("sets") > BLOCK, wide).otherwise(F.array(F.lit(0).cast("long")))
    rows, columns = (F.ceil(F.col(c) / BLOCK) for c in ("outside", "sets"))
    own = F.pmod(F.xxhash64("name"), rows if outside else columns)
    others = F.sequence(F.lit(0).cast("long"), (columns if outside else rows) - 1)
    blocks = F.transform(others, lambda k: own * columns + k if outside else k * columns + own)
    return entries.withColumn("band", F.explode(bands)).withColumn("block", F.explode(blocks))


def grouped(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label: the component of each set (name, grams) that any link reaches.

    Pairs within a component that other links have joined already need not be tried. Each
    round's links join the components so far, which stand as one edge a set.
    """
    entries = staged(_prefixes(sets, percent).withColumn("label", F.col("name")), "prefixes")
    budget = PAIRS_PER_ENTRY * entries.count()
    tried = staged(_candidates(_heads(entries, 0), entries, percent), "pairs")
    labels = staged(components(staged(_verified(tried, sets, percent), "links")), "labels")
    for turn in range(1, TURNS + 1):
        known = labels.select(F.col("node").alias("name"), F.col("label").alias("new"))
        marked = entries.join(known, "name", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        marked = staged(marked, "labelled")
        outside = staged(_outsiders(marked), "open_grams")
        left = outside.agg(F.sum(F.col("sets").cast("double") * F.col("outside"))).first()[0]
        if left is None:
            break
        entries = staged(marked.join(outside, "gram"), "open")
        final = left <= budget or turn == TURNS
        if final:
            some, every = _in_blocks(entries.where("label <> main"), percent, True), _in_blocks(entries, percent, False)
            pairs = _candidates(some, every, percent, ("gram", "band", "block"))
        else:
            pairs = _candidates(_heads(entries, turn), entries, percent)
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = staged(_verified(pairs, sets, percent), "links")
        if not found.isEmpty():
            so_far = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = staged(components(so_far.unionByName(found)), "labels")
        if final:  # every pair of different components has been tried
            break
        tried = staged(tried.unionByName(pairs), "tried")
        entries = entries.drop("main", "sets", "outside")
    return labels


def classes(df: DataFrame, n: int = N, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, version (hash of the text), n_shingles, component_id, and stays.

    Texts are lower-cased in A-Z and split at white space. Two rows link if the sets of their
    n-word shingles share ``percent`` % of their union; a text of fewer words counts as one
    shingle. Rows without words are linked with nothing. Null keys name no component: the
    least key that is not null does, for a row alone its own. ``stays`` marks the row of each
    component that has the least key, or rows of equal key and text if there are several.
    """
    docs = df.select(
        df[key].alias("key"), df[key].cast("long").alias("doc"), F.xxhash64(df[text]).alias("version"), df[text].alias("text")
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least_buckets = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least_buckets, -(-size // BUCKET_BYTES))
    in_buckets = _emit(docs, buckets, n).groupBy("bucket").applyInArrow(
        lambda table: _shared_in_bucket(table),
        "batch long, counts binary, docs array<struct<doc:long,version:long,n:long,name:binary,shared:long>>",
    )
    rows = in_buckets.groupBy("batch").applyInArrow(
        lambda table: _shared_in_batch(table), "doc long, version long, n long, name binary, shared long"
    )
    rows = staged(rows, "sets")
    # A link needs percent % of the union, so at least that share of either set.
    enough = rows.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    chosen = enough.groupBy("name").agg(F.min(F.struct("doc", "version")).alias("row"))
    chosen = staged(chosen.select("name", "row.*"), "distinct_sets")
    if chosen.count() <= KEY_BROADCAST:  # spares the other documents a shuffle
        chosen = F.broadcast(chosen)
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc", "version")]
    texts = docs.alias("d").join(chosen.alias("c"), match).select("c.name", "d.text")
    sets = staged(_sets(texts.dropDuplicates(["name"]), n), "grams")
    labels = grouped(sets, percent)
    last = F.lit((1 << 63) - 1)
    out = rows.join(labels.withColumnRenamed("node", "name"), "name", "left")
    out = out.withColumn("label", F.coalesce("label", "name"))
    out = staged(out.withColumn("order", F.struct(F.coalesce("doc", last).alias("doc"), "version")), "labelled_rows")
    least = out.groupBy("label").agg(F.min("doc").alias("component"), F.min("order").alias("first"))
    out = out.join(staged(least, "least"), "label")
    alone = F.col("n") == 0
    return out.select(
        "doc", "version", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("component")).alias("component_id"),
        (alone | (F.col("order") == F.col("first"))).alias("stays"),
    )


def near_duplicates(df: DataFrame, n: int = N, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles and component_id, as ``classes`` defines them."""
    found = classes(df, n, percent, key, text)
    return found.select(F.col("doc").alias(key), "n_shingles", "component_id")


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns; rows without words all stay."""
    order, version = fresh(df, "order_key"), fresh(df, "text_version")
    last = F.lit((1 << 63) - 1)
    keep = classes(df, key=key, text=text).where("stays")
    keep = keep.select(F.coalesce("doc", last).alias(order), F.col("version").alias(version))
    keep = staged(keep.distinct(), "kept_rows")
    marked = df.withColumns({order: F.coalesce(F.col(key).cast("long"), last), version: F.xxhash64(text)})
    kept = marked.join(keep, [order, version], "left_semi")
    return kept.dropDuplicates([order, version]).select(*df.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


OP5_SQL = r"""
with recursive split as (
    select doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
),
shingles as (
    select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as s
    from split, unnest(generate_series(1, greatest(1, len(words) - 4))) as t(i)
    where len(words) > 0
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
meets as (
    select a.doc_id as a, b.doc_id as b, count(*) as both
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
    group by all
),
links as (
    select o.a, o.b from meets o join sizes x on x.doc_id = o.a join sizes y on y.doc_id = o.b
    where 100 * o.both >= 80 * (x.n + y.n - o.both)
),
reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select r.doc_id, coalesce(n, 0) as n_shingles, min(r.other) as component_id
from reach r left join sizes using (doc_id)
group by r.doc_id, n
"""

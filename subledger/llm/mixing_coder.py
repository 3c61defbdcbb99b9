"""Token ids in compressed, checksummed blocks that can each be read alone.

A block's ids are dealt to lanes of neighbouring ids, and all lanes are coded side by side,
one id of each a step. They share one model, which starts empty in every block and learns
from all ids of a step before the next. For each id it has three predictions: the id that
followed the last two ids (order 2), the one that followed the last id (order 1), and how
often ids came up that neither foresaw (order 0). How far orders 2 and 1 are trusted is
learned as well, for each pair of their run lengths, and mixes the three into one
distribution over all ids. A range coder per lane, without carries, writes 16-bit words.

Integers throughout: reading gives the same numbers on any machine.
"""

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subledger.llm.library_ids import library_cache, with_end
from subledger.llm.text import Texts, documents, rows_a_batch, slices
from subledger.sources.shared_folder import new_path, staged

MAGIC = b"MXR1"
HEADER = struct.Struct("<4sIIIII")  # magic, ids, lanes, vocabulary, checksum of the ids, documents
BLOCK_IDS = 1 << 21
TEXTS_A_BATCH, TEXT_BYTES = 1000, 1 << 20  # sent to a worker at once, split at once
LANES, LEAST_STEPS = 8192, 256
TOTAL_BITS = 24  # resolution of a step's distribution
LEAST_ORDER0_BITS, SPARE_BITS = 16, 2  # order 0 has four units an id, at least so many bits in all
REBUILD = 4  # a new order-0 table comes when a quarter as many ids are new as it was made from
ID_BITS, MOST_RUN = 20, 7
ORDER2_BITS = 18
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
U = np.uint64


class BadBlock(ValueError):
    """A block that is damaged or no block at all."""


class Model:
    """The three predictions and their mixture."""

    def __init__(self, vocabulary: int, lanes: int, reading: bool = False):
        self.vocabulary, self.reading = vocabulary, reading
        self.bits = max(LEAST_ORDER0_BITS, vocabulary.bit_length() + SPARE_BITS)
        self.order1 = np.zeros(vocabulary, dtype=np.int32)  # id | run << ID_BITS
        self.order2 = np.zeros(1 << ORDER2_BITS, dtype=np.int32)
        self.seen, self.unforeseen, self.new, self.total = np.zeros(vocabulary, dtype=np.int64), [], 0, 0
        self.bounds = np.zeros(vocabulary + 1, dtype=np.int64)
        self.outcomes = np.tile(np.array([2, 2, 4], dtype=np.int64), (2 * (MOST_RUN + 1) ** 2, 1))
        self.last = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)
        self.step = 0
        self.rebuild()

    def rebuild(self) -> None:
        """Order-0 intervals of a fixed total; every id keeps at least one unit."""
        if self.unforeseen:
            self.seen += np.bincount(np.concatenate(self.unforeseen), minlength=self.vocabulary)
            self.total += self.new
            self.unforeseen, self.new = [], 0
        room = (1 << self.bits) - self.vocabulary
        # whole parts of quotients of numbers below 2^53: doubles give them exactly
        units = 1 + (self.seen * room / max(1, self.total)).astype(np.int64)
        units[0] += (1 << self.bits) - units.sum()
        np.cumsum(units, out=self.bounds[1:])
        if self.reading:
            self.owner = np.repeat(np.arange(self.vocabulary, dtype=np.int32), units)

    def predict(self, n: int) -> None:
        """For the first n lanes: both predicted ids and the shares of the distribution."""
        self.last, self.before = self.last[:n], self.before[:n]
        self.context = (self.last * 40503 + self.before * 2654435761) >> 4 & ((1 << ORDER2_BITS) - 1)
        self.entry1, self.entry2 = self.order1.take(self.last), self.order2.take(self.context)
        mask = np.int32((1 << ID_BITS) - 1)
        self.id1, self.id2 = self.entry1 & mask, self.entry2 & mask
        self.run1, self.run2 = self.entry1 >> ID_BITS, self.entry2 >> ID_BITS
        state = (self.run2 * np.int32(MOST_RUN + 1) + self.run1) * np.int32(2) + (self.id1 == self.id2)
        self.state = state.astype(np.int64)
        total = self.outcomes.sum(axis=1)
        shares = (self.outcomes[:, :2] * (15 << TOTAL_BITS - 4)) // total[:, None]
        shares = np.maximum(shares, 1)
        self.share2, both = shares[:, 0].take(self.state), shares.sum(axis=1)
        self.rest = both.take(self.state)
        self.room = (1 << TOTAL_BITS) - self.rest

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' parts of the distribution begin, and how wide they are."""
        self.hit2, self.hit1 = ids == self.id2, ids == self.id1
        begin = self.rest + (self.bounds.take(ids) * self.room >> self.bits)
        end = self.rest + (self.bounds.take(ids + 1) * self.room >> self.bits)
        np.copyto(begin, self.share2, where=self.hit1)
        np.copyto(end, self.rest, where=self.hit1)
        begin[self.hit2] = 0
        np.copyto(end, self.share2, where=self.hit2)
        return begin, end - begin

    def learn(self, ids: np.ndarray) -> None:
        """After ``interval`` of the same ids."""
        hit2, missed = self.hit2, ~(self.hit1 | self.hit2)
        outcome = np.where(hit2, 0, 1 + missed)
        counts = np.bincount(self.state * 3 + outcome, minlength=self.outcomes.size)
        self.outcomes += counts.reshape(-1, 3)
        if self.step % 64 == 63:
            self.outcomes = (self.outcomes + 1) // 2 + 1
        one, small = np.int32(1 << ID_BITS), ids.astype(np.int32)
        for table, at, entry, run, hit in (
            (self.order1, self.last, self.entry1, self.run1, self.hit1),
            (self.order2, self.context, self.entry2, self.run2, hit2),
        ):
            new = np.where(run > 0, entry - one, small)
            np.copyto(new, entry + one * (run < MOST_RUN), where=hit)
            table[at] = new
        self.unforeseen.append(ids[missed])
        self.new += len(self.unforeseen[-1])
        self.before, self.last = self.last, ids
        self.step += 1
        if self.new * REBUILD > self.total:
            self.rebuild()


def _layout(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids."""
    lanes = min(LANES, max(1, n // LEAST_STEPS))
    return lanes, -(-n // lanes) if n else 0


def _active(n: int, steps: int, step: int) -> int:
    """Lanes that still have an id at a step: the first ones, as the last may be short."""
    return (n - step + steps - 1) // steps


def _moves(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which lanes have a word that no longer changes, or too little room left."""
    return ((low ^ (low + width)) < TOP) | (width < BOTTOM)


def _moved(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lanes after their top word has gone; a carry that would reach it is cut off."""
    settled = (low ^ (low + width)) < TOP
    width = np.where(settled, width, (~low + U(1)) & (BOTTOM - U(1)))
    return low << U(16), width << U(16)


def compressed(ids: np.ndarray, vocabulary: int) -> tuple[int, bytes]:
    """Lanes, and the lanes' word counts and words."""
    n = len(ids)
    lanes, steps = _layout(n)
    grid = np.zeros(lanes * steps, dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    out_lanes, out_words = [], []
    for step in range(steps):
        active = _active(n, steps, step)
        own = grid[step, :active].astype(np.int64)
        model.predict(active)
        begin, room = model.interval(own)
        low, width = low[:active], width[:active]  # what lanes that ended have left is in ``out``
        unit = width >> U(TOTAL_BITS)
        low += unit * begin.view(np.uint64)
        width = unit * room.view(np.uint64)
        model.learn(own)
        at = np.flatnonzero(_moves(low, width))
        while len(at):
            lo, wi = low[at], width[at]
            out_lanes.append(at.astype(np.uint16))
            out_words.append((lo >> U(48)).astype(np.uint16))
            low[at], width[at] = lo, wi = _moved(lo, wi)
            at = at[_moves(lo, wi)]
        ended = active if step + 1 == steps else _active(n, steps, step + 1)
        for shift in (48, 32, 16, 0) if ended < active or step + 1 == steps else ():
            done = np.arange(0 if step + 1 == steps else ended, active, dtype=np.uint16)
            out_lanes.append(done)
            out_words.append((low[done] >> U(shift)).astype(np.uint16))
    by_lane = np.concatenate(out_lanes)
    words = np.concatenate(out_words)[np.argsort(by_lane, kind="stable")]
    counts = np.bincount(by_lane, minlength=lanes)
    return lanes, counts.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def expanded(n: int, lanes: int, vocabulary: int, payload: memoryview) -> np.ndarray:
    steps = -(-n // lanes)
    counts = np.frombuffer(payload, dtype="<u4", count=lanes).astype(np.int64)
    words = np.append(np.frombuffer(payload, dtype="<u2", offset=4 * lanes), np.zeros(8, "<u2"))
    place = np.cumsum(counts) - counts
    code = np.zeros(lanes, dtype=np.uint64)
    for _ in range(4):
        code = code << U(16) | words[place]
        place += 1
    model = Model(vocabulary, lanes, reading=True)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    grid = np.zeros((steps, lanes), dtype="<u4")
    for step in range(steps):
        active = _active(n, steps, step)
        model.predict(active)
        low, width, code, place = low[:active], width[:active], code[:active], place[:active]
        unit = width >> U(TOTAL_BITS)
        at = _quotient(code - low, unit)
        # the last id whose interval begins at or before ``at``; both numbers are exact as doubles
        first = ((at - model.rest + 1) << model.bits) - 1
        target = (first.astype(np.float64) / model.room.astype(np.float64)).astype(np.int64)
        own = model.owner.take(np.clip(target, 0, (1 << model.bits) - 1))
        np.copyto(own, model.id1, where=at < model.rest)
        np.copyto(own, model.id2, where=at < model.share2)
        own = own.astype(np.int64)
        begin, room = model.interval(own)
        low += unit * begin.view(np.uint64)
        width = unit * room.view(np.uint64)
        model.learn(own)
        grid[step, :active] = own
        at = np.flatnonzero(_moves(low, width))
        while len(at):
            code[at] = code[at] << U(16) | words.take(place[at], mode="clip")
            place[at] += 1
            low[at], width[at] = lo, wi = _moved(low[at], width[at])
            at = at[_moves(lo, wi)]
    return grid.T.reshape(-1)[:n]


def _quotient(number: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """``number // unit``, at most the last place of the distribution."""
    most = U((1 << TOTAL_BITS) - 1)
    near = (number.astype(np.float64) / unit.astype(np.float64)).astype(np.uint64)
    near = np.minimum(near, most)
    near -= near * unit > number  # the estimate is off by one at most
    near += number - near * unit >= unit
    return np.minimum(near, most).view(np.int64)


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block of the ids of whole documents; ``lengths`` are the documents' id counts."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    if vocabulary > 1 << 19:
        raise ValueError("ids from 524288 on are not supported")
    lanes, payload = compressed(ids, vocabulary) if len(ids) else (1, b"")
    head = HEADER.pack(MAGIC, len(ids), lanes, vocabulary, zlib.crc32(ids), len(lengths))
    return head + lengths.astype("<u4").tobytes() + payload


class Documents(NamedTuple):
    """Ids of whole documents in pieces, their numbers of ids, and their keys."""

    ids: list
    lengths: list
    keys: list

    def held(self) -> int:
        return sum(self.lengths)

    def __add__(self, other: "Documents") -> "Documents":
        return Documents(*(a + b for a, b in zip(self, other, strict=True)))


class Block(NamedTuple):
    ids: np.ndarray  # little-endian unsigned 32-bit
    lengths: np.ndarray


def decode_block(data: bytes | pa.Buffer) -> Block:
    """The ids and documents' lengths; ``BadBlock`` if the checksum does not fit."""
    try:
        magic, n, lanes, vocabulary, checksum, n_docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise BadBlock("not a block of token ids")
        lengths = np.frombuffer(data, dtype="<u4", count=n_docs, offset=HEADER.size)
        payload = memoryview(data)[HEADER.size + 4 * n_docs :]
        ids = expanded(n, lanes, vocabulary, payload) if n else np.empty(0, "<u4")
    except (struct.error, ValueError, IndexError, ZeroDivisionError, MemoryError) as error:
        raise BadBlock(str(error)) from error
    if zlib.crc32(ids) != checksum or lengths.sum() != n:
        raise BadBlock("checksum does not fit")
    return Block(ids, lengths)


def encoded(column: pa.Array, tokenizer_path: str, end_id: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """The texts of a column a MB at a time, all their ids, and where each text's begin."""
    for texts in slices(column, TEXT_BYTES):
        yield texts, *with_end(*library_cache(tokenizer_path).encoded(texts), end_id)


def write_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Blocks of whole documents in ascending order of ``key`` (null first), as a table.

    ``file`` and ``block`` order them; ``keys`` names a block's documents, ``n_ids`` counts
    its ids, ``data`` is the block. A block ends with the document that fills it.
    """

    def run(batches):
        file, block = TaskContext.get().partitionId(), 0
        whole, open_ = Documents([], [], []), Documents([], [], [])  # a full block waits for what follows
        key_type = pa.int64()

        def row(docs: Documents) -> pa.RecordBatch:
            data = encode_block(np.concatenate(docs.ids), np.array(docs.lengths, dtype=np.int64))
            columns = [(file, pa.int32()), (block, pa.int32()), (docs.held(), pa.int64()), (docs.keys, pa.list_(key_type)), (data, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["file", "block", "n_ids", "keys", "data"])

        for batch in batches:
            key_type = batch.column(0).type
            for texts, own, rows in encoded(batch.column(1), tokenizer_path, end_id):
                names = batch.column(0).slice(texts.first, texts.last - texts.first).to_pylist()
                first = 0
                while first < len(names):
                    # documents up to the one that fills the block
                    last = int(np.searchsorted(rows, rows[first] + BLOCK_IDS - open_.held()))
                    last = min(max(last, first + 1), len(names))
                    lengths = np.diff(rows[first : last + 1]).tolist()
                    open_ = open_ + Documents([own[rows[first] : rows[last]]], lengths, names[first:last])
                    first = last
                    if open_.held() >= BLOCK_IDS:
                        if whole.keys:
                            yield row(whole)
                            block += 1
                        whole, open_ = open_, Documents([], [], [])
        if whole.keys and open_.held() >= BLOCK_IDS // 2:
            yield row(whole)
            block, whole = block + 1, Documents([], [], [])
        if rest := (whole + open_).keys and whole + open_:  # a short end joins the block before
            yield row(rest)

    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(df[key], df[text]).repartitionByRange(df[key]).sortWithinPartitions(key)
    blocks = ordered.mapInArrow(run, f"file int, block int, n_ids long, keys array<{kind}>, data binary")
    with rows_a_batch(df.sparkSession, TEXTS_A_BATCH):  # bounded by bytes as well
        blocks.write.parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Each document: key, start (ids of all before it), n_tokens, and its ids.

    With ``digest`` the checksum ``ids_crc32`` of the ids stands in for them.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["keys"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(3)):
                block = decode_block(data.as_buffer())
                bounds = np.append(0, np.cumsum(block.lengths.astype(np.int64)))
                if digest:
                    raw = memoryview(block.ids.view(np.uint8))
                    own = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())
                else:
                    own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(block.ids.view(np.int32)))
                n = len(block.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column(1)[i].as_py(), np.int32)),
                        batch.column(2)[i].values,
                        pa.array(bounds[:-1]),
                        pa.array(block.lengths.astype(np.int64)),
                        own,
                    ],
                    ["file", "block", key, "at", "n_tokens", last.split()[0]],
                )

    schema = f"file int, block int, {key} {kind}, at long, n_tokens long, {last}"
    with rows_a_batch(spark, 1):  # a row is a block
        docs = staged(stored.select("file", "block", "keys", "data").mapInArrow(run, schema), "read_ids")
    sizes = staged(stored.select("file", "block", "n_ids"), "block_sizes")
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    starts = sizes.select("file", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(files, "file").select("file", "block", (F.col("file_start") + F.col("block_start")).alias("first"))
    out = docs.join(starts, ["file", "block"])
    return out.select(key, (F.col("first") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token_blocks")
    write_ids(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_ids(spark, path, digest=True)

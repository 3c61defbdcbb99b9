"""Byte-pair merges by an index from each pair to all its positions.

The pieces that a worker has not met before lie one behind the other as chains of symbols.
An index lists, for the rank of every pair of neighbours, all positions where that pair stands.
Ranks are taken in ascending order: the pair is merged at all its positions, from left to
right, and the pairs that each merge brings about are entered in the lists of their ranks.
Positions whose pair has gone are passed over when their rank's turn comes.

That equals the merges of each piece by itself as long as no merge uses a symbol that a later
one makes: then the pairs that a merge brings about have higher ranks. ``Merges`` checks
this when it reads the file.

Null and empty texts have no ids; every row counts for itself, repeated keys included; other
columns are left out, whatever their names; an empty table gives no rows. Texts of any length
are encoded whole. Nothing is shuffled, so no key or source gathers anywhere.
"""

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from subledger.llm.library_ids import added_tokens, byte_letters
from subledger.llm.pieces import PieceCache, gathered
from subledger.llm.text import Texts, documents, slices

END, GONE = -1, -2  # behind each piece; a symbol that was merged into the one before it
FEW = 48  # positions that are merged one by one


class Merges:
    """The merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        _require_plain(description)
        vocabulary: dict[str, int] = description["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in description["model"]["merges"]]
        self.added = added_tokens(description)
        self.of_byte = np.array([vocabulary[letter] for letter in byte_letters()], dtype=np.int64)
        self.left = [vocabulary[a] for a, _ in pairs]
        self.right = [vocabulary[b] for _, b in pairs]
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.rank = {a << 32 | b: rank for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        made_at = dict(zip(self.made, range(len(pairs)), strict=True))
        if any(max(made_at.get(a, -1), made_at.get(b, -1)) >= self.rank[a << 32 | b] for a, b in zip(self.left, self.right, strict=True)):
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.keys = np.sort(np.fromiter(self.rank, dtype=np.int64, count=len(self.rank)))
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes, self.ends = _token_bytes(vocabulary, self.added)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; -1 where there is no such merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def _require_plain(description: dict) -> None:
    """Stop at a file whose ids depend on more than byte letters, the split and merges."""
    model, before = description["model"], description["pre_tokenizer"]
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and description["normalizer"] is None
        and description["post_processor"] is None
        and before["type"] == "ByteLevel"
        and before["use_regex"]
        and not before["add_prefix_space"]
    )
    if not plain:
        raise ValueError("only plain byte-level merges are supported")


def _token_bytes(vocabulary: dict[str, int], added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and where each id's end."""
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    tokens = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
    for text, i in vocabulary.items():
        tokens[i] = bytes(byte[letter] for letter in text)
    for text, i in added.items():
        tokens[i] = text
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum([len(t) for t in tokens])


class PairIndex:
    """Chains of symbols, and the positions of every pair that has a rank."""

    def __init__(self, merges: Merges, pieces: list[bytes]):
        self.merges = merges
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.symbols = np.full(int(self.ends[-1]) + 1, END, dtype=np.int64)
        inside = np.ones(len(self.symbols), dtype=bool)
        inside[self.ends] = False
        self.symbols[inside] = merges.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        self.after = np.arange(1, len(self.symbols) + 1)
        self.before = np.arange(-1, len(self.symbols) - 1)
        self.before[0] = len(self.symbols) - 1
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.enter(merges.ranks_of(self.symbols[:-1], self.symbols[1:]), np.arange(len(self.symbols) - 1))

    def enter(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Enter places in the lists of their ranks; those of rank -1 have no pair."""
        real = np.flatnonzero(ranks >= 0)
        if not len(real):
            return
        real = real[np.argsort(ranks[real], kind="stable")]
        ranks, places = ranks[real], places[real]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            rank = int(ranks[low])
            if rank not in self.few:
                self.few[rank] = []
                heapq.heappush(self.active, rank)
            if high - low < FEW:
                self.few[rank] += places[low:high].tolist()
            else:
                self.many.setdefault(rank, []).append(places[low:high])

    def merge(self) -> None:
        """Merge everything, the lowest active rank first."""
        while self.active:
            rank = heapq.heappop(self.active)
            few, many = self.few.pop(rank), self.many.pop(rank, None)
            if many is None and len(few) < FEW:
                self.one_by_one(rank, sorted(set(few)))
                continue
            places = np.unique(np.concatenate([np.array(few, dtype=np.int64), *(many or [])]))
            if self.merges.left[rank] == self.merges.right[rank]:
                self.one_by_one(rank, places.tolist())
            else:
                self.at_once(rank, places)

    def one_by_one(self, rank: int, places: list[int]) -> None:
        """Merge at ascending places; of overlapping ones the left one counts."""
        a, b, made = self.merges.left[rank], self.merges.right[rank], self.merges.made[rank]
        symbols, after, before = memoryview(self.symbols), memoryview(self.after), memoryview(self.before)
        known = self.merges.rank
        for p in places:
            q = after[p]
            if symbols[p] != a or symbols[q] != b:
                continue
            r, left = after[q], before[p]
            symbols[p], symbols[q], after[p], before[r] = made, GONE, r, p
            for place, pair in ((left, symbols[left] << 32 | made), (p, made << 32 | symbols[r])):
                new = known.get(pair)  # never found if one of the two is END
                if new is not None:
                    if new not in self.few:
                        self.few[new] = []
                        heapq.heappush(self.active, new)
                    self.few[new].append(place)

    def at_once(self, rank: int, places: np.ndarray) -> None:
        """Merge at all places; as the pair's symbols differ, none overlap."""
        a, b, made = self.merges.left[rank], self.merges.right[rank], self.merges.made[rank]
        places = places[self.symbols[places] == a]
        second = self.after[places]
        stands = self.symbols[second] == b
        places, second = places[stands], second[stands]
        behind = self.after[second]
        self.symbols[places], self.symbols[second] = made, GONE
        self.after[places], self.before[behind] = behind, places
        left = self.before[places]
        one = self.merges.ranks_of(self.symbols[left], self.symbols[places])
        two = self.merges.ranks_of(self.symbols[places], self.symbols[behind])
        self.enter(np.concatenate([one, two]), np.concatenate([left, places]))

    def ids(self) -> list[list[int]]:
        """The symbols of each piece."""
        alive = self.symbols >= 0
        bounds = [0, *np.cumsum(alive)[self.ends].tolist()]
        ids = self.symbols[alive].tolist()
        return [ids[low:high] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


class Coder:
    """Encoding and decoding of whole texts; each distinct piece is merged once a worker."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cache = PieceCache(self.merged, whole=tuple(self.merges.added))

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        added = self.merges.added
        own = [p for p in pieces if p not in added]
        index = PairIndex(self.merges, own) if own else None
        if index:
            index.merge()
        found = iter(index.ids() if index else ())
        return [[added[p]] if p in added else next(found) for p in pieces]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where the ids of each text begin."""
        return self.cache.encoded(texts)

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[str]:
        """The text of each row's ids; bytes that are no UTF-8 become U+FFFD."""
        ends = self.merges.ends[ids]
        starts = np.where(ids > 0, self.merges.ends[ids - 1], 0)
        data, bounds = gathered(self.merges.bytes, starts, ends, rows)
        edges = bounds.tolist()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield data[low:high].tobytes().decode("utf-8", errors="replace")


@cache
def coder(path: str) -> Coder:
    """One for each Python worker and file."""
    return Coder(path)


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of ``text`` (null: none) as an array; other columns are left out.

    ``path`` names a tokenizer file that every executor can open.
    """

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(1)):
                ids, rows = coder(path).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
                keys = batch.column(0).slice(texts.first, texts.last - texts.first)
                yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key], df[text]).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def texts_of(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of ``ids``; null stays null, bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            sizes = np.array([len(row or ()) for row in rows], dtype=np.int64)
            flat = np.array([i for row in rows for i in row or ()], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            out = [None if row is None else text for row, text in zip(rows, coder(path).decode(flat, bounds), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[ids]).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text encoded and its ids decoded again: their number, and SHA-256 sums of both.

    A null or empty text has no ids; both sums are those of nothing.
    """

    def run(batches):
        for batch in batches:
            by, counts, of_ids, of_text = coder(path), [], [], []
            for texts in slices(batch.column(1)):
                ids, rows = by.encode(texts)
                raw, edges = memoryview(ids.astype("<u4").tobytes()), (rows * 4).tolist()
                of_ids += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                of_text += [hashlib.sha256(t.encode()).hexdigest() for t in by.decode(ids, rows)]
                counts += np.diff(rows).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(df[key], df[text]).mapInArrow(run, schema).withColumnRenamed("key", key)


def op13_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))

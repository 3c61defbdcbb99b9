"""Byte-pair merges as a transducer that reads bytes and emits token ids.

The transducer is determinised while it runs. Its state holds every place at which a token
may still be open: the node of that token in the vocabulary's trie, and the ids chosen up
to that place that no longer agree with the ids before the other places. Reading a byte
moves all open tokens on. Where one ends, a place after it opens; its ids are those before
the token plus the token, and of all tokens that end there exactly one may follow its
predecessor, namely that which merging the two tokens' bytes alone leaves as they are.
Ids that all places agree on are emitted. A place closes when its bytes begin no token, so
the look-ahead is bounded by the longest token. States and steps are kept, up to a bound;
beyond it the places are moved without being kept.

``Utf8Stream`` turns ids back into text as they arrive, and holds back the bytes of a
character that is not complete yet.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from subledger.llm.pieces import PieceCache, gathered
from subledger.llm.text import Texts, documents, slices

DECODE_CHUNK = 1 << 14  # ids that the streaming decoder takes at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, from lines of base64 text and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 40_000, most_pairs: int = 300_000):
        self.ranks = ranks
        self.most_states, self.most_pairs = most_states, most_pairs
        self.token = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]  # by trie node
        self.accepts: list[int] = [-1]
        for text, i in ranks.items():
            node = 0
            for byte in text:
                after = self.child[node].get(byte)
                if after is None:
                    after = self.child[node][byte] = len(self.accepts)
                    self.accepts.append(-1)
                    self.child.append({})
                node = after
            self.accepts[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        start = ((0, ()),)
        self.states = {start: 0}
        self.members: list[tuple] = [start]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, text: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges one by one, lowest rank first, of ranks under ``below``."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            rank = min(ranks)
            if rank >= below:
                break
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; none for a single byte."""
        if token not in self.split:
            parts = self.merged(self.token[token], token)
            two = len(parts) == 2
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if two else None
        return self.split[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes leaves just these two.

        Undoes the merges on either side of the border, the latest first, and looks for a
        merge across the border that would have come before the one undone last.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, 1 << 60, True
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < limit:
                good = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (a > b or not of_b):
                # at equal ranks the left merge comes first, so one across must be lower
                limit, a = a, of_a[1]
            elif of_b:
                limit, b = b + 1, of_b[0]
            else:
                break
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def moved(self, members: tuple, byte: int) -> list[tuple[int, tuple[int, ...]]]:
        """All places after one more byte; the place behind it comes last."""
        out, opened = [], None
        child, accepts = self.child, self.accepts
        for node, chosen in members:
            after = child[node].get(byte)
            if after is None:
                continue
            if child[after]:  # else no longer token goes on from here
                out.append((after, chosen))
            token = accepts[after]
            if token >= 0 and opened is None and (not chosen or self.follows(chosen[-1], token)):
                opened = (*chosen, token)
        if opened is None:
            raise ValueError("no token ends here: the ranks lack a single byte")
        out.append((0, opened))
        return out

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]] | None:
        """The next state and the ids emitted, built at first use; none if there is no room."""
        if len(self.members) >= self.most_states:
            return None
        moved = self.moved(self.members[state], byte)
        # All ids that the places share are out, but the last: the next pair needs it.
        head, shared = moved[0][1], 0
        for at in range(min(len(chosen) for _, chosen in moved)):
            if any(chosen[at] != head[at] for _, chosen in moved):
                break
            shared += 1
        drop = max(0, shared - 1)
        key = tuple((node, chosen[drop:]) for node, chosen in moved)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
        self.steps[state][byte] = (found, head[:drop])
        return found, head[:drop]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        direct = self.ranks.get(piece)
        if direct is not None:
            return [direct]
        if not piece:
            return []
        out: list[int] = []
        state, steps = 0, self.steps
        for i, byte in enumerate(piece):
            move = steps[state].get(byte) or self.step(state, byte)
            if move is None:
                # No room for more states: move the places of this one, without keeping them.
                members = self.members[state]
                for rest in piece[i:]:
                    members = self.moved(members, rest)
                return out + list(members[-1][1])
            state, emitted = move
            if emitted:
                out.extend(emitted)
        return out + list(self.members[state][-1][1])


class Utf8Stream:
    """Text from byte chunks: states 0 to 3 count the bytes that a character still lacks.

    Bytes that are no UTF-8 become U+FFFD, as Python's ``errors="replace"`` has it.
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def lacking(tail: bytes) -> int:
        """How many bytes at the end begin a character without ending it."""
        for back in range(1, min(3, len(tail)) + 1):
            byte = tail[-back]
            if byte & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 1
            if needs <= back:
                return 0
            # a second byte that no character has there ends the wait
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= tail[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.pending + chunk
        keep = self.lacking(data[-3:])
        self.pending = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", errors="replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", errors="replace")


def decoded(ids: Iterable[int], token: dict[int, bytes]) -> Iterator[str]:
    """The text of ids, as soon as each character is complete."""
    stream = Utf8Stream()
    for i in ids:
        if text := stream.feed(token[i]):
            yield text
    if text := stream.close():
        yield text


class Coder:
    """Encoding and decoding of many texts with the ranks of one file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.cache = PieceCache(lambda pieces: [self.transducer.encode(p) for p in pieces])
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for text, i in self.ranks.items():
            tokens[i] = text
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.decimals = [str(i) for i in range(len(tokens))]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where the ids of each text begin."""
        return self.cache.encoded(texts)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, a chunk at a time."""
        stream = Utf8Stream()
        for k in range(0, len(ids), DECODE_CHUNK):
            part = ids[k : k + DECODE_CHUNK]
            ends = self.ends[part]
            starts = np.where(part > 0, self.ends[part - 1], 0)
            yield stream.feed(gathered(self.bytes, starts, ends, np.zeros(1, int))[0].tobytes())
        yield stream.close()


@cache
def coder(path: str) -> Coder:
    """One for each Python worker and file."""
    return Coder(path)


def encoded(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """``key`` and the ids of ``text`` (null: none) as an array; other columns are left out.

    ``ranks_path`` names a rank file that every executor can open. With ``check`` all ids are
    decoded again; a text that does not come back ends the job.
    """

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(1)):
                ids, rows = coder(ranks_path).encode(texts)
                if check and "".join(coder(ranks_path).decode(ids)).encode() != texts.data.tobytes():
                    raise ValueError("a text does not come back from its ids")
                lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
                keys = batch.column(0).slice(texts.first, texts.last - texts.first)
                yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key], df[text]).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def texts_of(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of ``ids``; null stays null, bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        for batch in batches:
            decode = coder(ranks_path).decode
            out = [
                None if row is None else "".join(decode(np.array(row, dtype=np.int64)))
                for row in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[ids]).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text encoded and its ids decoded again: counts and SHA-256 sums of both, no ids.

    A null or empty text has no ids; both sums are those of nothing.
    """

    def run(batches):
        for batch in batches:
            by, counts, of_ids, of_text = coder(ranks_path), [], [], []
            for texts in slices(batch.column(1)):
                ids, rows = by.encode(texts)
                for first, last in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    own, sha = ids[first:last], hashlib.sha256()
                    names = by.decimals
                    of_ids.append(hashlib.sha256(" ".join([names[i] for i in own.tolist()]).encode()).hexdigest())
                    for part in by.decode(own):
                        sha.update(part.encode())
                    of_text.append(sha.hexdigest())
                    counts.append(last - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(df[key], df[text]).mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(documents(spark, sf_dir, "doc_id", "text"), path)

"""The split of text before byte-pair merges, by array arithmetic, and a cache of encoded pieces.

The split follows the published pattern: a contraction, or letters, digits or other marks
with at most one space before them, or white space that keeps its last character for what
follows. Each distinct piece is encoded once per Python worker, by the function given.
"""

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import regex

from subledger.llm.text import TAIL, Texts, eights, mixed, same_spans, word_hashes

SLOT_BITS = 21
NEAR_BITS = 15  # of a small table before the large one, for the pieces that come up all the time
SHORT = 7  # bytes that fit a key beside their number
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the regex library."""
    if not _classes:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run in regex.finditer(pattern, every):
                table[np.frombuffer(run.group().encode("utf-32-le"), dtype=np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def occurrences(texts: Texts, words: Sequence[bytes]) -> list[tuple[int, int]]:
    """Byte spans of ``words`` inside the texts: the leftmost first, of several there the longest."""
    raw = texts.data.tobytes()
    if not any(word in raw for word in words):
        return []
    pattern = regex.compile(b"|".join(map(regex.escape, sorted(words, key=len, reverse=True))))
    edges = texts.bounds.tolist()
    return [m.span() for k in range(len(edges) - 1) for m in pattern.finditer(raw, edges[k], edges[k + 1])]


def split(texts: Texts, whole: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all pieces, and for each text the index of its first piece.

    ``bounds[i]:bounds[i + 1]`` is piece i; the pieces of text k are ``rows[k]:rows[k + 1]``.
    Each place where one of ``whole`` stands is a piece; what lies between is split by itself.
    """
    data, n_bytes = texts.data, len(texts.data)
    if not n_bytes:
        return np.zeros(1, dtype=np.int64), np.zeros(len(texts.bounds), dtype=np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    wide = n != n_bytes
    at = np.flatnonzero((data & 0xC0) != 0x80) if wide else np.arange(n)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)  # the first character of each text
    kept = occurrences(texts, whole) if whole else []
    edges = np.unique(np.concatenate([texts.bounds, np.array(kept, dtype=np.int64).reshape(-1)]))
    edges = np.searchsorted(at, edges) if wide else edges
    first[edges] = True
    first[n] = True
    opens = first[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # A white-space run before another character of its text gives up its last one.
    ends = np.ones(n, dtype=bool)
    ends[:-1] = opens[1:]
    last = np.flatnonzero(space & ends & ~first[1:])
    joins = last[points[last] == 0x20]
    opens[last] = True
    opens[joins + 1] = False
    # A lone apostrophe that no space precedes takes a contraction's letters.
    quotes = np.flatnonzero((points == 0x27) & opens & ends)
    if len(quotes):
        one = np.append(points, [0, 0]).astype(np.int64)
        a, b = one[quotes + 1], one[quotes + 2]
        same = ~first[quotes + 1]
        short = same & np.isin(a, [ord(c) for c in "stmd"])
        pair = np.isin(a * 256 + b, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
        long = same & pair & ~first[np.minimum(quotes + 2, n)]
        opens[quotes[short | long] + 1] = False
        after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        opens[after[after < n]] = True
    for start, end in kept:
        low, high = np.searchsorted(at, (start, end))
        opens[low + 1 : high] = False
    starts = at[opens]
    return np.append(starts, n_bytes), np.searchsorted(starts, texts.bounds)


class PieceCache:
    """Ids of pieces; of bounded size, emptied when full.

    A piece of up to seven bytes is its own key. A longer one is found by a hash, and its bytes
    are compared with those kept before it counts as found.
    """

    def __init__(
        self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1 << 20, whole: Sequence[bytes] = ()
    ):
        self.encode, self.most, self.whole = encode, most, whole
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.near_keys = np.zeros(1 << NEAR_BITS, dtype=np.uint64)
        self.near_slots = np.full(1 << NEAR_BITS, -1, dtype=np.int32)
        self.ids, self.bounds = np.empty(1 << 20, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)
        self.raw, self.places = np.empty(1 << 20, dtype=np.uint8), np.zeros(1 << 12, dtype=np.int64)
        self.count = 0

    def _add(self, pieces: list[bytes]) -> int:
        """Encode and keep the pieces and their bytes; the number of the first."""
        base, encoded = self.count, self.encode(pieces)
        self.count += len(pieces)
        for bounds, values, sizes, name in (
            ("bounds", "ids", map(len, encoded), "flat"),
            ("places", "raw", map(len, pieces), "raw"),
        ):
            edges = _room(getattr(self, bounds), self.count + 1)
            edges[base + 1 : self.count + 1] = edges[base] + np.cumsum(np.fromiter(sizes, np.int64, len(pieces)))
            held = _room(getattr(self, values), int(edges[self.count]))
            if name == "flat":
                new = np.fromiter(chain.from_iterable(encoded), np.int32, int(edges[self.count] - edges[base]))
            else:
                new = np.frombuffer(b"".join(pieces), np.uint8)
            held[edges[base] : edges[self.count]] = new
            setattr(self, bounds, edges)
            setattr(self, values, held)
        return base

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The piece kept under each key, -1 for none."""
        hashes = mixed(keys)
        near = (hashes >> np.uint64(64 - NEAR_BITS)).view(np.int64)
        piece = np.where(self.near_keys.take(near) == keys, self.near_slots.take(near), -1)
        far = np.flatnonzero(piece < 0)
        slot = (hashes[far] & np.uint64((1 << SLOT_BITS) - 1)).view(np.int64)
        known = self.keys.take(slot) == keys[far]
        far, slot = far[known], slot[known]
        piece[far] = self.slots.take(slot)
        self.near_keys[near[far]], self.near_slots[near[far]] = keys[far], piece[far]
        return piece.astype(np.int64)

    def encoded(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where the ids of each text begin."""
        return self.encoded_pieces(texts.data, *split(texts, self.whole))

    def encoded_pieces(self, data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are split already."""
        starts, sizes = bounds[:-1], np.diff(bounds)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(rows), dtype=np.int64)
        if self.count > self.most:
            self.clear()
        keys, long = piece_keys(data, bounds)
        piece = self._found(keys)
        doubtful = long[piece[long] >= 0]
        kept = piece[doubtful]
        same = self.places[kept + 1] - self.places[kept] == sizes[doubtful]
        doubtful, kept = doubtful[same], kept[same]
        piece[long] = -1
        same = same_spans(data, starts[doubtful], self.raw, self.places[kept], sizes[doubtful])
        piece[doubtful[same]] = kept[same]
        missing = np.flatnonzero(piece < 0)
        while len(missing):
            new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            one = missing[where]
            every = data.tobytes()
            base = self._add([every[s:e] for s, e in zip(starts[one].tolist(), bounds[one + 1].tolist(), strict=True)])
            piece[missing] = base + back
            at = (mixed(new) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            self.keys[at], self.slots[at] = new, base + np.arange(len(new))
            # Pieces of one key but other bytes than the first of them go another round.
            first, known = one[back], sizes[missing] > SHORT
            differ = known & (sizes[first] != sizes[missing])
            check = np.flatnonzero(known & ~differ & (first != missing))
            differ[check] = ~same_spans(data, starts[missing[check]], data, starts[first[check]], sizes[first[check]])
            missing = missing[differ]
        return gathered(self.ids, self.bounds[piece], self.bounds[piece + 1], rows)


def piece_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each piece, and which pieces are so long that it is a hash and no proof."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    top = np.uint64(56)
    keys = (eights(data)[starts] & TAIL[np.minimum(sizes, SHORT)]) | sizes.astype(np.uint64) << top
    long = np.flatnonzero(sizes > SHORT)
    keys[long] = word_hashes(data, starts[long], bounds[long + 1]) | np.uint64(1 << 63)
    return keys, long


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` of them."""
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), dtype=values.dtype)])


def gathered(values, starts, ends, rows) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``values`` one after another; where each row's part begins."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return values[index], offsets[rows]

import random

import public_tokenizers
import pyarrow as pa
import regex

from subledger.llm.pieces import split
from subledger.llm.text import NON_SPACE, slices, span_hashes, words_of
from tests.llm.common import awkward_texts

PATTERN = regex.compile(public_tokenizers.PATTERN)


def test_split_equals_the_pattern():
    rng = random.Random(1)
    letters = list("ab' \n\ts re ve ll dmt01é9  ''!.,ñ中 　\x1c\x85🙂ſ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [*awkward_texts(), "don't we'll 's x's ''s 'st I'VE", "a  ", "a \n b", " 're"]
    for part in slices(pa.array(texts, pa.string()), 1 << 12):
        bounds, rows = split(part)
        raw = part.data.tobytes()
        for k in range(part.last - part.first):
            own = [raw[bounds[i] : bounds[i + 1]].decode() for i in range(rows[k], rows[k + 1])]
            assert own == PATTERN.findall(texts[part.first + k] or "")


def test_words_and_their_hashes():
    texts = awkward_texts()
    seen: dict[int, bytes] = {}
    for part in slices(pa.array(texts, pa.string()), 1 << 12):
        words = words_of(part, part.data, NON_SPACE)
        hashes = span_hashes(part.data, words.starts, words.ends).tolist()
        for k in range(part.last - part.first):
            spans = range(words.rows[k], words.rows[k + 1])
            own = [part.data[words.starts[i] : words.ends[i]].tobytes() for i in spans]
            assert own == regex.findall(rb"[^\x20\x09-\x0D]+", (texts[part.first + k] or "").encode())
            for i, word in zip(spans, own, strict=True):
                assert seen.setdefault(hashes[i], word) == word
    assert len(set(seen.values())) == len(seen)

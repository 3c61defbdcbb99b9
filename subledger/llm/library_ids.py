"""Token ids by the tokenizers library, which sees each distinct piece of text once a worker."""

import json
from functools import cache

import numpy as np

from subledger.llm.pieces import PieceCache


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte.

    Visible Latin-1 characters stand for themselves, the rest for what follows U+00FF.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + others.index(b)) for b in range(256)]


def added_tokens(description: dict) -> dict[bytes, int]:
    """Strings that a tokenizer file takes out of the text before its split, and their ids."""
    added = description.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return {t["content"].encode(): t["id"] for t in added}


@cache
def library_cache(path: str, special: bool = True) -> PieceCache:
    """Ids of whole texts by a byte-level tokenizer file that every executor can open.

    The library's model merges the pieces of its split one by one, so distinct pieces
    suffice. Strings of added tokens become their ids, as ``Tokenizer.encode`` has it; without
    ``special`` they count as text, as if ``encode_special_tokens`` were set.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, dict(enumerate(byte_letters()))
    added = added_tokens(json.loads(tokenizer.to_str())) if special else {}

    def encode(pieces: list[bytes]) -> list[list[int]]:
        text, at, out = b"".join(pieces).decode("latin-1").translate(letters), 0, []
        for piece in pieces:
            end = at + len(piece)
            out.append([added[piece]] if piece in added else [t.id for t in model.tokenize(text[at:end])])
            at = end
        return out

    return PieceCache(encode, whole=tuple(added))


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each row's, and the rows' new bounds."""
    return np.insert(ids, rows[1:], end_id), rows + np.arange(len(rows))

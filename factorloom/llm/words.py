"""Words, word hashes and shingle sets inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from factorloom.llm.common import give_back
from factorloom.llm.tokens import _Bounded

_WORD = re.compile(r"[^ \t-\r]+")
#: What ``str.split`` takes as white space beyond the six ASCII characters.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_LOWER = {c: c + 32 for c in range(65, 91)}

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT_A, _SHIFT_B = np.uint64(30), np.uint64(27)


def pieces_of(batches, rows: int = 256):
    """Record batches cut into short ones, so that a task holds few decoded texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def words_of(text: str | None) -> list[str]:
    """The matches of ``[^\\x20\\x09-\\x0D]+``."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


_HASHES = _Bounded(lambda w: xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass")), 150_000)


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash for each word, the same on every machine."""
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> _SHIFT_A)) * _MIX_B
    return x ^ (x >> _SHIFT_B)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n]
    for k in range(1, size):
        out = mix(out * _MIX_A + hashes[k : k + n])
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes (63 bits) of the distinct runs of ``size`` lower-cased words.

    A text with fewer words, but some, has its whole sequence as its only
    shingle; one without words has none.
    """
    words = words_of(ascii_lower(text)) if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    return np.unique((window_hashes(hash_words(words), min(size, len(words))) >> np.uint64(1)).view(np.int64))

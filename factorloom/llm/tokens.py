"""Exact token ids of whole texts through the ``tokenizers`` library, with a word cache.

``word_bpe_49k`` drops white space before its merges, so a text's ids are the
ids of its words (runs of letters, digits, marks) in a row. Lower-cased words
without their marks repeat far more than white-space separated pieces do; each
worker keeps their ids. The texts of a batch are cut into words together, on their
bytes, and one dictionary of words that are known and words of the chunk tells the
new ones, which alone are tokenized. Texts with other than Latin characters go
piece by piece, and any tokenizer of another shape is called on the whole text instead.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factorloom.llm.common import give_back

#: Id appended to every document.
END_ID = 1
END_BYTES = np.array([END_ID], dtype="<u4").tobytes()

_PIECE = re.compile(r"[^ \t\n\r]+")
#: Pieces of these characters are unchanged by NFC and lower-cased one by one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PRE = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r]+")
#: A text of such pieces only.
_PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t\n\r]+")
#: Longer pieces and words are not kept.
_KEPT = 200
#: Texts are cut into words together up to this many bytes; a longer one alone.
_CHUNK = 1 << 21


_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _byte_kinds() -> np.ndarray:
    """The kind of each UTF-8 byte of plain texts, whose two-byte characters all begin with C3."""
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    kinds[0x21:0x7F] = _MARK
    kinds[0x30:0x3A] = _DIGIT
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    kinds[[0x97, 0xB7]] = _OTHER  # × and ÷
    kinds[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    return kinds


_KIND = _byte_kinds()
#: Bytes of plain texts in lower case: A-Z, and the second bytes of À-Þ.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x80:0x9F] += 32

# The steps of a tokenizer file for which the cache is exact.
_STEPS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Bounded(dict):
    """A dictionary that fills itself and starts anew when it is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class _Recent(_Bounded):
    """A dictionary that fills itself, up to twice ``limit``: when full it keeps the newest entries beside what is asked for again."""

    def __init__(self, make, limit: int):
        super().__init__(make, limit)
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _KEPT:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, without an end id."""

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_piece = steps == _STEPS and splits[:1] == [_SPLIT] and not spec.get("post_processor")
        self.letters = _byte_letters()
        self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.words = _Recent(self._word, cache // 4)
        self.pieces = _Bounded(self._piece, cache)
        #: Words of plain texts as one array, up to half of ``cache``: their ids behind each other, how many, and the chunk that had the word last.
        self.limit, self.now = cache // 2, 0
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, dtype="<u4")
        self.sizes, self.last = np.zeros((2, 0), dtype=np.int32)
        del spec
        give_back()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) > _KEPT or not _PLAIN.fullmatch(piece) or any(a in piece for a in self.added):
            return self._whole(piece)
        return b"".join([self.words[w] for w in _PRE.findall(piece.lower())])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self._whole(text)
        if _PLAIN_TEXT.fullmatch(text) and not any(a in text for a in self.added):
            return b"".join(map(self.words.__getitem__, _PRE.findall(text.lower())))
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text in order (null: empty); plain ones of a chunk are cut into words together."""
        if not self.by_piece:
            for text in texts:
                yield self.encode(text.as_py())
            return
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets, data = texts.buffers()[1:]
        at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else [0]
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(at, at[low] + _CHUNK, "right")) - 1)
            size = int(at[high] - at[low])
            part = np.frombuffer(data, dtype=np.uint8, count=size, offset=int(at[low])) if size else np.zeros(0, dtype=np.uint8)
            ids, ends, odd = self._chunk(part, at[low : high + 1] - at[low])
            for k in range(high - low):
                yield self.encode(texts[low + k].as_py()) if k in odd else ids[ends[k] : ends[k + 1]]
            del ids, ends
            give_back()
            low = high

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int], set[int]]:
        """The ids of texts that lie between the places ``at``, where each text's begin and end, and the texts that are not plain and left out."""
        kind, text_of = _KIND[data], lambda places: np.searchsorted(at, places, "right") - 1
        odd = set(text_of(np.flatnonzero(kind == _OTHER)).tolist())
        for added in self.added:
            odd |= {int(text_of(m.start())) for m in re.finditer(re.escape(added.encode()), data)}
        for k in odd:
            kind[at[k] : at[k + 1]] = _SPACE
        data = _LOWER[data]
        begins = kind == _DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[at[at < len(data)]] = True
        # ``_PRE``'s short forms: an apostrophe that begins a word, and one or two letters behind it
        quotes = np.flatnonzero((data == ord("'")) & begins & (kind == _MARK))
        room = at[text_of(quotes) + 1] - quotes
        for letters in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
            size = len(letters) + 1
            some = quotes[room >= size]
            for k, letter in enumerate(letters, 1):
                some = some[data[some + k] == letter]
            begins[some + 1] = False
            begins[some[some + size < len(data)] + size] = True
        kept = kind != _SPACE
        word_at = np.searchsorted(np.flatnonzero(begins & kept), at)
        data, begins = data[kept], begins[kept]
        del kind, kept
        starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        which = self._learn(pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)))
        del data, begins, starts
        firsts, counts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes, self.sizes[which]
        ends = np.append(np.int32(0), np.cumsum(counts, dtype=np.int32))
        places = np.repeat(firsts[which] - ends[:-1], counts)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = self.flat[places]
        self._forget()
        return ids.tobytes(), (4 * ends[word_at].astype(np.int64)).tolist(), odd

    def _learn(self, words: pa.StringArray) -> np.ndarray:
        """The place of each word among the known ones, to which new ones are added."""
        n = len(self.known)
        coded = pa.concat_arrays([self.known, words]).dictionary_encode()  # known words differ, so each keeps its place
        which, self.known, self.now = coded.indices.to_numpy()[n:], coded.dictionary, self.now + 1
        found = list(map(self._word, self.known[n:].to_numpy(zero_copy_only=False).tolist()))
        self.flat = np.append(self.flat, np.frombuffer(b"".join(found), dtype="<u4"))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4)
        self.last = np.append(self.last, np.zeros(len(found), dtype=np.int32))
        self.last[which] = self.now
        return which

    def _forget(self) -> None:
        """Beyond the limit, in words or in bytes, keep the half of the known words that came last, without long ones."""
        if len(self.known) > self.limit or self.known.nbytes + self.flat.nbytes > 64 * self.limit:
            held = np.zeros(len(self.known), dtype=bool)
            held[np.argsort(-self.last, kind="stable")[: min(len(held), self.limit) // 2]] = True
            held &= pc.binary_length(self.known).to_numpy() <= _KEPT
            self.flat, self.known = self.flat[np.repeat(held, self.sizes)], self.known.filter(pa.array(held))
            self.sizes, self.last = self.sizes[held], self.last[held]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file; its cache lives across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

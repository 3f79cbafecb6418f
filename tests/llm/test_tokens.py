"""What the encoder keeps, and that ids are the tokenizer's own."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from factorloom.llm import tokens


def test_plain_texts_are_looked_up_by_word():
    """Marks and case beside a word cost no entry of their own; ids are those of the library on the whole text."""
    enc, tok = tokens.Encoder(tokens.default_tokenizer(), 8), Tokenizer.from_file(tokens.default_tokenizer())
    r = random.Random(5)
    bits = ["word", "Word,", "'s", "'re", "''ll", "it's", "I'D", "é", "ÀB", "ß", "12", ".", "!!", " ", "  ", "\n", "\t\r\n", "-", "x" * 300, "<", "|", "'"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(40)) for _ in range(300)] + [" ", "\n\n", "'", "<|endoftext|>", "a<|endoftext|>b", "字 word", "a b", "a\x0bb", "é"]
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    enc = tokens.Encoder(tokens.default_tokenizer())
    enc.encode("word Word, word. (word) WORD!")
    assert set(enc.words) == {"word", ",", ".", "(", ")", "!"} and not enc.pieces


def test_texts_of_a_batch_are_cut_into_words_together(monkeypatch):
    """Ids of each text are the library's, however texts fall into chunks and whatever was forgotten; a word is tokenized once a batch."""
    tok, r = Tokenizer.from_file(tokens.default_tokenizer()), random.Random(7)
    bits = ["word", "Word,", "'s", "'re", "''ll", "it's", "I'D", "'sve", "é", "ÀB", "ß", "12", ".", "!!", "  ", "\n", "\t\r\n", "-", "x" * 300, "<", "'", "×", "字", "<|startoftext|>", "İ"]
    texts = [None, "", "'", "'r", "e", " ", *("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(12))) for _ in range(400)), "<|endof", "text|>", "don'", "t", None]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for chunk, cache in ((1, 8), (50, 8), (1 << 21, 8), (50, 400)):
        monkeypatch.setattr(tokens, "_CHUNK", chunk)
        enc = tokens.Encoder(tokens.default_tokenizer(), cache)
        for skipped in (0, 3):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(pa.array(texts).slice(skipped))] == want[skipped:]
        assert len(enc.known) <= cache // 2
    enc, asked = tokens.Encoder(tokens.default_tokenizer()), []
    enc._word = lambda w, make=enc._word: asked.append(w) or make(w)
    assert list(enc.encode_all(pa.array(["word, Word", "other WORD", ""]))) and sorted(asked) == [",", "other", "word"] and not enc.words
    assert not list(enc.encode_all(pa.array([], pa.string())))

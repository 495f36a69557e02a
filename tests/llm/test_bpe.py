import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm import bpe

from .data import documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(bpe.encoder(PATH).encode(text), "<u4")
    assert got.tolist() == want
    decoded = bpe.encoder(PATH).v.decode(got.astype(np.int64)).decode(errors="replace")
    assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["the", " ", "  ", "\n", " \n", "'s", "'LL", "<|endoftext|>", "é", "漢", "\x1c", "\x85", "\u3000", "12", "!?", "ing", "\U0001F600"])))
def test_pieces_agree_with_the_library(parts):
    same(Tokenizer.from_file(PATH) if not hasattr(test_pieces_agree_with_the_library, "t")
         else test_pieces_agree_with_the_library.t, "".join(parts))


test_pieces_agree_with_the_library.t = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_agrees_with_the_library(text):
    same(test_pieces_agree_with_the_library.t, text)


def test_long_words_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    for text in ("a" * 5000, "thethethe" * 200, "abcdefgh ijkl mnop qrst uvwx yz"):
        same(library, text)


def test_every_row_has_a_result(spark, library):
    docs = documents(spark, texts())
    docs = docs.unionByName(docs)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == 2 * len(texts())
    for r in got:
        want = library.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert hashlib.sha256(bytes(r.ids)).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()
        assert r.text == (texts()[r.doc_id] or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0

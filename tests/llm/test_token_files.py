import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postloom.llm import token_files
from postloom.scratch import Scratch

from .data import documents, prose, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_round_trip(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", block_bytes)
    all_texts = [*texts(), "x <|endoftext|> y", "a \n b ", "nul\0 byte", *(prose(30, k) for k in range(40))]
    folder = Scratch(spark, "t").root
    token_files.write(documents(spark, all_texts), folder, PATH, end_id=0)
    library, start = Tokenizer.from_file(PATH), 0
    got = {r.id: r for r in token_files.read(spark, folder).collect()}
    for i, text in enumerate(all_texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert (got[i].start, got[i].n) == (start, len(ids))
        start += len(ids)
    one = token_files.read_documents(spark, folder, [7]).collect()
    assert [(r.id, r.ids) for r in one] == [(7, got[7].ids)]


def test_null_ids_and_repeats_and_empty(spark):
    rows = spark.createDataFrame([(None, "b c"), (3, "a"), (3, "a"), (1, None)], "doc_id long, text string")
    folder = Scratch(spark, "t").root
    token_files.write(rows, folder, PATH)
    got = sorted((r.start, r.id, r.n) for r in token_files.read(spark, folder).collect())
    assert [g[1] for g in got] == [None, 1, 3, 3] and [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]
    folder = Scratch(spark, "t").root
    token_files.write(rows.limit(0), folder, PATH)
    assert token_files.read(spark, folder).count() == 0


def test_another_dictionary_is_refused():
    block = token_files._block(0, 0, "d", "<u2", [(1, 2, b"xx")])
    header, index, frames = next(token_files.blocks(block + b"\n" + block))
    assert (header["dictionary"], index["ids"].tolist(), bytes(frames)) == ("d", [2], b"xx")
    with pytest.raises(ValueError):
        list(token_files.blocks(b"other"))


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.model, name)


def test_new_words_of_all_texts_take_one_call_of_the_model():
    own = token_files._Ids(PATH)
    own.model = Counted(own.model)
    parts = ["don't", "x's", "a--b", "_u_", "'", "''s", "m².", "½,", "naïve.", "«é»", "ɐx", "aɐ", "日本.", "é", "\x00", "7th", "(no)", "ÿ\x7f", "\ny"]
    all_texts = [f"w{k} {prose(20, k)} {p} {p}{k} {k}{p} end" for k, p in enumerate(parts * 4)]
    library = Tokenizer.from_file(PATH)
    for _ in range(2):  # learned, then remembered
        got = [np.frombuffer(x, own.kind).tolist() for x in own.encode(all_texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in all_texts]
    assert own.model.calls == 1

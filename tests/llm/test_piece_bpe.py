"""The agenda against the library, and decoding."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from utilscope.llm import piece_bpe
from utilscope.llm.piece_bpe import NotAsLibrary, PieceBpe, encode_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_and_long_texts_as_the_library(library):
    bpe, rng = PieceBpe(MODEL), random.Random(4)
    letters = "ab  ▁\n\tthe éß😀x.,'́</s><s>　\xa0漢字0123"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "\x00", "a" * 50_000, " " * 999, "ab" * 20_000, "\n" * 500]
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text)


def test_list_and_heap_agendas_agree():
    bpe, rng = PieceBpe(MODEL), random.Random(5)
    for _ in range(2000):
        part = "▁" + "".join(rng.choice("theraniongé漢\n") for _ in range(rng.randint(0, 30)))
        symbols = [bpe.symbols.get(c, -1 - ord(c)) for c in part]
        assert bpe._short(list(symbols)) == bpe._long(list(symbols))


def test_rows_nulls_and_packed_ids(documents, library):
    pairs = [(1, "Hello  world"), (2, None), (2, ""), (None, "▁x y")]
    rows = encode_texts(documents(pairs), MODEL, ["doc_id"]).collect()
    packed = encode_texts(documents(pairs), MODEL, ["doc_id"], packed=True, check="texts").collect()
    for (i, text), row, bits in zip(pairs, rows, packed):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert (row["doc_id"], row["ids"], row["decoded"]) == (i, ids, library.decode(ids))
        assert np.frombuffer(bits["ids"], "<u4").tolist() == ids
    assert encode_texts(documents([]), MODEL, ["doc_id"]).collect() == []


def test_columns_of_the_result_cannot_be_kept(documents):
    with pytest.raises(ValueError):
        encode_texts(documents([]).withColumnRenamed("id", "ids"), MODEL, ["ids"])


def test_units_unlike_the_library_stop_the_job(library):
    bpe = PieceBpe(MODEL)
    bpe.encode("some words here")
    bpe.check_fresh(library)
    bpe.encode("other words")
    bpe.kept["▁other"] = b"\0\0\0\0"
    with pytest.raises(NotAsLibrary):
        bpe.check_fresh(library)


def test_a_small_store_forgets_and_finds_again(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_UNITS", 3)
    monkeypatch.setattr(piece_bpe, "KEPT_PARTS", 2)
    bpe, text = PieceBpe(MODEL), "a b, c; d. a b, e! f? g: a b, c; " * 5
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text)
    bpe.check_fresh(library)

import hashlib
import random
import struct
import time

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusframe.llm import packing, piece_codec, token_count

from .conftest import ODD, prose

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


COUNT, CODE = token_count.counter(BPE, P.PATTERN, 500), piece_codec.coder(PIECES, 500)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_counts_equal_the_library(library, text):
    assert COUNT([0], [text])[2] == [len(library.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgh the  ▁\n.,'\"-_<>éñ漢字🙂0123"), max_size=80))
def test_codec_equals_the_library(pieces, text):
    raw, said = CODE(text)
    ids = pieces.encode(text, add_bos=True, add_eos=True)
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids and said == pieces.decode(ids)


def test_odd_texts_and_bounded_memory(library, pieces):
    r = random.Random(1)
    texts = [t for t in ODD if t] + [prose(r, 400) for _ in range(40)]
    assert COUNT(list(range(len(texts))), texts)[2] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        ids = pieces.encode(t, add_bos=True, add_eos=True)
        raw, said = CODE(t)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids and said == pieces.decode(ids)
    encode = packing.tokenizer(*packing.gpt_parts())
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_query(spark, odd_docs, no_docs, library):
    rows = token_count.token_counts(odd_docs, BPE, P.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        text = "a" if row["doc_id"] is None else ODD[row["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (n, len(text.encode()), n > 1024)
    assert token_count.token_counts(no_docs, BPE, P.PATTERN).count() == 0


def test_codec_query(spark, odd_docs, no_docs, pieces):
    for row in piece_codec.encode_decode(odd_docs, PIECES, keep=True).collect():
        text = "a" if row["doc_id"] is None else ODD[row["doc_id"]] or ""
        ids = pieces.encode(text, add_bos=True, add_eos=True)
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == pieces.decode(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_decode(no_docs, PIECES).count() == 0


def test_long_run_without_spaces_is_linear(pieces):
    text = "".join(random.Random(2).choice("abcdefghijk") for _ in range(60_000))
    raw, said = CODE(text)
    assert said == text and list(struct.unpack(f"<{len(raw) // 4}I", raw)) == pieces.encode(text, add_bos=True, add_eos=True)


def test_long_words_are_counted_in_near_linear_time(library):
    r = random.Random(4)
    words = ["".join(r.choice(a) for _ in range(n)) for a, n in (("ab", 3000), ("abcdefghij", 60_000), ("é漢ñ", 9000), ("a", 50_000))]
    texts = [*words, " ".join(words), words[1] + " short words " + words[0]]
    assert COUNT(list(range(len(texts))), texts)[2] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    began = time.process_time()
    COUNT([0], ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))])
    assert time.process_time() - began < 60


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aabcdeé ", min_size=1, max_size=400), min_size=1, max_size=4))
def test_words_beyond_the_rounds(library, texts):
    before, token_count.ROUNDS = token_count.ROUNDS, 3
    try:
        got = token_count.counter(BPE, P.PATTERN)(list(range(len(texts))), texts)[2]
    finally:
        token_count.ROUNDS = before
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]

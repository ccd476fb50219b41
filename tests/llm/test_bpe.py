"""BPE against the tokenizers library: chunk joins, whole documents, odd input."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitefacts.llm import bpe
from tests.llm.odd import no_documents, odd_documents, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TEXTS = st.text(st.one_of(st.sampled_from("abc déE1 2'\n.,  \tst<|>endofx日本🙂 ́"), st.characters(codec="utf-8", max_codepoint=0x2FFFF)), max_size=120)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_equal_to_the_library(text):
    library = test_equal_to_the_library.library = getattr(test_equal_to_the_library, "library", None) or Tokenizer.from_file(PATH)
    assert bpe.encode(bpe.encoding(PATH), text.encode()).tolist() == ids_of(library, text)


@given(st.lists(st.sampled_from(["the ", "reading", " it's", "<|endof", "text|>", "don't ", "\n\n", "  ", "x", "él ", "123", " 45", "日本", ". ", "Word word word ", " a b c d e ", "и снова слово ", "\n", "東京、", "です。", "\u3000", "\u00a0", "\u0085", "é ", "\u0301"]), max_size=60), st.sets(st.integers(1, 300), max_size=25))
@settings(max_examples=300, deadline=None)
def test_joins(pieces, cuts):
    data = "".join(pieces).encode()
    tokenizer = bpe.encoding(PATH)
    joiner = bpe.Joiner(tokenizer, bpe.token_lengths(tokenizer))
    edges = sorted({0, len(data), *(c for c in cuts if c < len(data) and data[c] & 0xC0 != 0x80)})
    parts = [data[a:b] for a, b in zip(edges, edges[1:])]
    if parts:
        listed = [(p, bpe.encode(tokenizer, p) if i % 3 else None) for i, p in enumerate(parts)]
        assert joiner.document(listed).tolist() == bpe.encode(tokenizer, data).tolist()


LONG = {"Cyrillic": "Съешь ещё этих мягких французских булок, да выпей чаю. ", "Japanese": "東京は、夜の七時です。しかし、朝は来る。", "no places": "日本語文字列", "one word a line": "слово\n"}


@pytest.mark.parametrize("name", LONG)
def test_work_is_linear(name, monkeypatch):
    """Of a long text whose chunks are known, little is encoded again; without places it is encoded once."""
    data = "".join(LONG[name] + (str(i) if name != "no places" else "") for i in range(8000 if name != "one word a line" else 30000)).encode()
    tokenizer = bpe.encoding(PATH)
    parts = [(c, bpe.encode(tokenizer, c)) for c in bpe.chunks(data)]
    want, plain, seen, scanned = bpe.encode(tokenizer, data).tolist(), bpe.encode, [], []
    joiner = bpe.Joiner(tokenizer, bpe.token_lengths(tokenizer))
    own = joiner.places
    monkeypatch.setattr(bpe, "encode", lambda t, d: seen.append(len(d)) or plain(t, d))
    monkeypatch.setattr(joiner, "places", lambda d, start=0: scanned.append(len(d) - start) or own(d, start))
    assert joiner.document(parts).tolist() == want
    assert sum(seen) <= (1 if name != "no places" else 1.01) * len(data) and sum(scanned) < 2.5 * len(data)


@given(st.text(max_size=400))
@settings(max_examples=60, deadline=None)
def test_chunks_are_the_text(text):
    parts = bpe.chunks(text.encode(), 3)
    assert b"".join(parts) == text.encode() and all(p.decode() for p in parts)


@pytest.mark.parametrize("bits", [9, 5])
def test_documents(spark, library, bits):
    made = bpe.encode_documents(odd_documents(spark), PATH, chunk_bits=bits, decode=True)
    got = sorted(((r.doc_id, list(r.ids), r.back) for r in made.select("doc_id", "ids", "text", bpe.decoded(made.ids, PATH).alias("back")).collect() if r.text == r.back), key=repr)
    want = sorted(((i, ids_of(library, t), t or "") for i, t in odd_texts()), key=repr)
    assert got == want
    assert bpe.encode_documents(no_documents(spark), PATH).count() == 0

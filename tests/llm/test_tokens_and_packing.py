import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyspark.llm import packing, token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


ODD = ["", " ", "  a  b ", "\n\n", "é日本語 🙂x", "▁▁ a▁b", "<s> x </s>", "a" * 700, "12 345", "\tx", "it's  I'll\r\n\x0b x　z\xa0q", "<|endoftext|> x", "a\x1cb c", "a\x85b c", "a\nb c\n", "x²½ ⅷ ́"]


@pytest.mark.parametrize("text", ODD)
def test_counts_equal_the_library(sp, text):
    assert token_counts.counter(PIECES).count(text) == len(sp.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abe ▁\nté1<>", max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    import sentencepiece

    assert token_counts.counter(PIECES).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


def test_models_of_another_kind_are_refused(tmp_path):
    """The same file with another trainer, normaliser or piece kind appended: later fields win."""
    with open(PIECES, "rb") as f:
        model = f.read()
    assert token_counts.unlike(model) == []
    field = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    changes = {"byte-pair": field(2, b"\x18\x01"), "fallback": field(2, b"\x98\x02\x00"), "normalises": field(3, b"\x20\x01"), "sign": field(3, b"\x18\x00"), "user": field(1, b"\x0a\x01x\x18\x04")}
    for word, more in changes.items():
        (why,) = token_counts.unlike(model + more)
        assert word in why
        (tmp_path / "m.model").write_bytes(model + more)
        with pytest.raises(ValueError, match=word):
            token_counts.PieceCounter(str(tmp_path / "m.model"))


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(tokenizer, text):
    got = np.frombuffer(packing.chunked_ids(BYTES).ids(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    global _T
    _T = globals().get("_T") or Tokenizer.from_file(BYTES)
    assert np.frombuffer(packing.chunked_ids(BYTES).ids(text), "<u4").tolist() == _T.encode(text, add_special_tokens=False).ids


def test_counts_over_a_table(spark, documents, nasty, no_docs, sp):
    for r in token_counts.token_counts(documents, PIECES).join(documents.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(sp.encode(r.text)) and r.n_bytes == len(r.text.encode()) and r.over_limit == (r.n_tokens > 4096)
    got = token_counts.token_counts(nasty, PIECES).collect()
    assert len(got) == nasty.count() and [(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (2, 3)] == [(0, 0)] * 2
    assert next(r for r in got if r.doc_id == 7).over_limit
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def check_packing(rows, want, size):
    """Every id of every document lies once in a piece; sequences have no gaps and little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length > 0
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for doc, ids in want:
        pieces = sorted(by_doc[doc, len(ids) // 4], key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    return padding


@pytest.mark.parametrize("windows, merge_partitions", [(64, 16), (2, 1)])
def test_packing_round_trip(spark, documents, windows, merge_partitions):
    enc = packing.chunked_ids(BYTES)
    want = [(r.doc_id, enc.ids(r.text) + bytes(4)) for r in documents.collect()]
    rows = packing.pack(documents.repartition(5), BYTES, windows=windows, merge_partitions=merge_partitions).collect()
    padding = check_packing(rows, want, 1024)
    assert padding <= 0.005 * sum(len(ids) // 4 for _, ids in want)


def test_packing_edges(nasty, no_docs):
    rows = packing.pack(nasty, BYTES).collect()
    assert {r.doc_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 5) == 2
    assert packing.pack(no_docs, BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 4), st.integers(0, 3))
def test_packer_against_its_rules(sizes, windows, slack):
    done = []
    packer = packing.Packer(16, windows, slack, done.append)
    docs = [(i, bytes(4 * n)) for i, n in enumerate(sizes)]
    for d in docs:
        packer.add(*d)
        assert len(packer.open) <= windows
    for w in done:
        assert 16 - slack <= sum(len(p[2]) // 4 for p in w) <= 16
    rest = list(packing.merge(packer.open, 16))
    lengths = [sum(len(p[2]) // 4 for p in w) for w in rest]
    assert all(n == 16 or n & (n - 1) == 0 for n in lengths)
    assert sum(map(len, (p[2] for w in done + rest for p in w))) == 4 * sum(sizes)

"""Hashes of words and of runs of words, on the patterns that cancel in polynomials modulo 2^64."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartlens.llm import bpe, brown, near, substring, words


def _pattern(bits, zero="a", one="b"):
    text = zero
    while len(text) < 1 << bits:
        text += text.translate(str.maketrans(zero + one, one + zero))
    return text


def _other(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_patterns_of_two_letters_have_hashes_of_their_own():
    texts = [t for bits in range(5, 18) for t in (_pattern(bits), _other(_pattern(bits)))]
    data = " ".join(texts).encode()
    found = words.split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(np.unique(found.hashes)) == len(texts)
    again = words.split(np.frombuffer(b"  x " + data, np.uint8), np.array([0, len(data) + 4]))
    assert (again.hashes[1:] == found.hashes).all()


def test_runs_of_two_words_have_hashes_of_their_own():
    for bits in (10, 12, 15):
        values = np.array([3 if c == "a" else 5 for c in _pattern(bits)], np.uint64)
        both = np.concatenate([values, 8 - values])
        hashes = words.spans_hash(both, np.array([0, len(values)]), np.array([len(values), len(both)]))
        assert hashes[0] != hashes[1]


@pytest.fixture(scope="module")
def twins(spark):
    rows = [(i, t) for i, t in enumerate(t for bits in (10, 12, 16) for t in (_pattern(bits), _other(_pattern(bits))))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_encoding(spark, twins):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.digests(twins[1]).collect():
        text = dict(twins[0])[r["doc_id"]]
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_compares_bytes(monkeypatch):
    """Every piece of one length shares a hash; ids are still those of the library."""
    monkeypatch.setattr(bpe, "spans_hash", lambda values, starts, ends: (ends - starts).astype(np.uint64))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["one two red fox", "two one fox, red!", "", "of an it 漢字 é"]
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_passages(spark):
    pairs = [(_pattern(b), _other(_pattern(b))) for b in (10, 11)]
    rest = [f"r{i}" for i in range(60)]
    # 61 words each that differ in one pattern word only, at the place all windows share.
    rows = [(k, " ".join([*rest[:30], p, *rest[30:]])) for k, p in enumerate(p for pair in pairs for p in pair)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == dict.fromkeys(range(4), 0)


def test_unseen_words(spark):
    rows = [(i, _pattern(10)) for i in range(1, 9)] + [(100, _other(_pattern(10)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = brown.fit_classes(docs.where("doc_id < 100"))
    found = {r["doc_id"]: r for r in brown.score_texts(docs, fitted).collect()}
    assert found[1]["n_known"] == 2 and found[100]["n_known"] == 1


def test_bags(spark):
    mark = [_pattern(10), _other(_pattern(10))]
    rows = [(k, " ".join(f"{m}" for _ in range(8))) for k, m in enumerate(mark)]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).members
    assert {r["doc_id"]: r["group_id"] for r in found.collect()} == {0: 0, 1: 1}

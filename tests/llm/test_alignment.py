"""Token groups of two tokenizers against the libraries and set arithmetic."""

import bisect
import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartlens.llm import alignment

TEXTS = [
    None, "", " ", "plain words, and more.", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "漢字テスト 한국어 😀😀👩‍👩‍👧 é ﬁ ½",
    "\x00\x01 nul", "a  b   c\t\n\n d\r\n  ", "=" * 5000, "ab" * 2000, " " * 1500 + "x", "don't we'll I'VE", "　\xa0  x​",
    "😀" * 300, "漢" * 900, "the same text", "the same text", "The the then there. " * 40, "word " * 30_000,
]


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _expected(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, rows, links, counts = _letters(), [], [], collections.Counter()
    for text in texts:
        rows.append([0, 0, 0, 0, ""])
        links.append([])
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
            else second.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        ends_a, ends_b = ([*itertools.accumulate(map(len, x))] for x in (bytes_a, bytes_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in both]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, end in zip(ids, ends):
                groups[bisect.bisect_left(both, end)][side].append(i)
        links[-1] = [p for x, y in groups for p in itertools.product(x, y)]
        counts.update(set(links[-1]))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows[-1] = [len(a), len(b), len(both), len(links[-1]), hashlib.sha256(text.encode()).hexdigest()]
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (*row[:4], sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), row[4])
        for row, own in zip(rows, links)
    ]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop_finds_every_place(short, long):
    short, long = (np.array(sorted(x), np.int64) for x in (short, long))
    assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()


@pytest.mark.parametrize("at_once", [1 << 22, 40])
def test_sums_match_the_libraries(spark, at_once):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "an id again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n long").repartition(3)
    found = [tuple(r) for r in alignment.link_sums(docs, at_once=at_once).collect()]
    expected = [(r[0], *x) for r, x in zip(rows, _expected([r[1] for r in rows]))]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert found and any(r[1] > 0 for r in found)


def test_groups_end_where_both_sides_end(spark):
    docs = spark.createDataFrame([(1, "Résumé of 😀 words, don't"), (2, None)], "doc_id long, text string")
    row, empty = alignment.align(docs).orderBy("doc_id").collect()
    a, b = alignment.side(alignment.FIRST), alignment.side(alignment.SECOND)
    data = " Résumé of 😀 words, don't".encode()
    for g in row["groups"]:
        for side, ids, n in ((a, row["ids_a"], g["a"]), (b, row["ids_b"], g["b"])):
            spelled = b"".join(side.bytes[side.starts[i] :][: side.lengths[i]].tobytes() for i in ids[:n])
            assert spelled == data[: g["bytes"]]
    assert row["groups"][-1]["bytes"] == len(data)
    assert (empty["ids_a"], empty["ids_b"], empty["groups"]) == ([], [], [])


def test_runs_that_exhaust_one_library(spark):
    text = "\n " * 300_000
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert alignment.side(alignment.FIRST).encode([text])[0].tolist() == other.encode(" " + text).ids


def test_wide_groups_are_summed_by_ids():
    a, b = alignment.side(alignment.FIRST), alignment.side(alignment.SECOND)
    own = alignment.Aligned(["漢" * 3 + "字" * 2, "x"], a, b)
    wide, alignment._WIDE_GROUP = alignment._WIDE_GROUP, 0
    try:
        found = own.pairs()
    finally:
        alignment._WIDE_GROUP = wide
    assert all((x == y).all() for x, y in zip(found, own.pairs()))


def test_no_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_sums(nothing).count() == 0
    assert alignment.align(nothing).count() == 0

"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import codecs
import contextlib
import functools
import hashlib
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartlens.llm.base import batches, slices
from cartlens.llm.words import spans_hash

# What a worker remembers within a task: pieces with their ids, and pairs of tokens.
_CACHED_PIECES = 1 << 18
_CACHED_PAIRS = 1 << 18
_IDS_AT_ONCE = 1 << 14
# Arrays over these characters take about 100 bytes each while they are split and looked up.
_CHARS_AT_ONCE = 1 << 18
_PIECES_COMPARED = 1 << 13

# The endings that the vocabulary's pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


@functools.cache
def _kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        kinds[c] = _LETTER if first == "L" else _NUMBER if first == "N" else _OTHER
    kinds[[ord(c) for c in _WHITE]] = _SPACE
    return kinds


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts that start at ``firsts``.

    A piece is a run of letters, of numbers or of other marks, with one space before it if there is
    one, or an apostrophe with a contraction's letters, or a run of white space without that space.
    """
    n = len(codes)
    kind = _kinds()[codes]
    new_text = np.zeros(n + 1, bool)
    new_text[firsts] = True
    new_text[n] = True
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    change = new_text[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    white = kind == _SPACE
    # The last white space before something else: a space of its own joins what follows,
    # other white space is a piece of its own if there is more before it.
    closes = np.zeros(n, bool)
    closes[:-1] = white[:-1] & ~white[1:] & ~new_text[1:n]
    start = change.copy()
    start |= closes
    glued = np.zeros(n, bool)
    glued[1:] = closes[:-1] & (codes[:-1] == 32)
    start &= ~glued
    # Contractions, where the apostrophe opens a piece.
    for at in np.flatnonzero((codes == 39) & start).tolist():
        for letters in CONTRACTIONS:
            to = at + 1 + len(letters)
            if to <= n and not new_text[at + 1 : to].any() and all(codes[at + 1 + i] == ord(c) for i, c in enumerate(letters)):
                start[at + 1 : to] = False
                if to < n:
                    start[to] = True
                break
    return np.flatnonzero(start)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merges by pair of ids, and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = _byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items() if t not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            left, right, both = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            self.merges.setdefault((left, right), (rank, both))
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        # A token never reaches over more bytes than this, so every way to cut a text has a
        # boundary among any so many places in a row: the lookahead that suffices.
        self.lookahead = max(map(len, self.id_of))
        self._parts = {both: (rank, *pair) for pair, (rank, both) in self.merges.items()}
        self._spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.known_stable: dict[int, bool] = {}
        # Every ending of a token, with the id of the token that is just that and comes out of its own bytes.
        self.endings = {b[i:]: -1 for b in self.id_of for i in range(1, len(b))}
        self.endings |= {b: i if self.merged(b) == [i] else -1 for b, i in self.id_of.items()}

    def merged(self, text: bytes) -> list[int]:
        """Ids after all merges, lowest rank first, from the left among equals."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            known = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not known:
                break
            _, i = min(known)
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that touch the left (1) or right (2) edge while ``token`` grows, and the rank that ends each."""
        found = self._spines.get((token, side))
        if found is None:
            found, part, ends = [], token, float("inf")
            while True:
                found.append((part, ends))
                if part not in self._parts:
                    break
                ends, part = self._parts[part][0], self._parts[part][side]
            found.reverse()
            self._spines[token, side] = found
        return found

    def stable(self, left: int, right: int) -> bool:
        """As ``boundary_stable``, remembered."""
        if len(self.known_stable) >= _CACHED_PAIRS:
            self.known_stable.clear()
        found = self.known_stable[left << 32 | right] = self.boundary_stable(left, right)
        return found

    def boundary_stable(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two tokens while their own merges take place.

        Both grow from their bytes; a pair that meets at the boundary merges if its rank comes before the
        merge that ends either of them, at equal ranks the one further left first.
        """
        a, b, merges = self._spine(left, 2), self._spine(right, 1), self.merges
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            crossing = merges.get((x, y))
            if crossing and crossing[0] < x_ends and crossing[0] <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(a) or j == len(b):
                return True


class Transducer:
    """Bytes in, token ids out as soon as no later byte can change them.

    For each place reached it keeps the one token that ends there in the encoding of the bytes so far: the
    token whose boundary with the one before is stable. All ways to go on pass one of the last ``lookahead``
    places; what the encodings of these places share at the front is final and leaves the window.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = b""  # bytes of the window
        self.last: list[int | None] = [None]  # token that ends at each place of the window
        self.before: int | None = None  # last token already given out

    def feed(self, data: bytes) -> list[int]:
        out, width = [], 4 * self.v.lookahead
        for at in range(0, len(data), width):
            self._extend(data[at : at + width])
            if len(self.last) > width:
                out += self._settled()
        return out

    def rewind(self, size: int) -> None:
        """Go back to the first ``size`` bytes; only while all bytes fed are still in the window."""
        self.text = self.text[:size]
        del self.last[size + 1 :]

    def _extend(self, data: bytes) -> None:
        v, last = self.v, self.last
        done = len(self.text)
        text = self.text = self.text + data
        endings, known = v.endings, v.known_stable
        for to in range(done + 1, len(text) + 1):
            tokens = []
            for i in range(to - 1, -1, -1):
                token = endings.get(text[i:to])
                if token is None:
                    break
                if token >= 0:
                    tokens.append((i, token))
            found = None
            for i, token in reversed(tokens):
                left = last[i] if i else self.before
                if left is None:
                    if i:
                        continue
                    ok = True
                else:
                    ok = known.get(left << 32 | token)
                    if ok is None:
                        ok = v.stable(left, token)
                if ok:
                    found = token
                    break
            last.append(found)

    def _path(self, place: int) -> list[int]:
        ids = []
        while place > 0:
            ids.append(self.last[place])
            place -= len(self.v.bytes_of[ids[-1]])
        return ids[::-1]

    def _settled(self) -> list[int]:
        """Give out what the encodings of the last places share, and forget it."""
        size = len(self.last)
        live = {p for p in range(max(0, size - self.v.lookahead), size) if self.last[p] is not None or p == 0}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - len(self.v.bytes_of[self.last[far]]))
        shared = live.pop()
        ids = self._path(shared)
        if ids:
            self.before = ids[-1]
            self.text = self.text[shared:]
            self.last = [None, *self.last[shared + 1 :]]
        return ids

    def finish(self) -> list[int]:
        return self._path(len(self.last) - 1)


class Encoder:
    """Ids of whole texts.

    Pieces met before are looked up by a 64-bit hash of their bytes while they are few enough, and their bytes
    compared; a piece that only shares a hash is encoded by itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        lengths = np.zeros(max(vocabulary.bytes_of) + 2, np.int64)
        for i, b in vocabulary.bytes_of.items():
            lengths[i + 1] = len(b)
        self.byte_bounds = np.cumsum(lengths)
        self.byte_table = np.frombuffer(
            b"".join(vocabulary.bytes_of.get(i, b"") for i in range(len(lengths) - 1)), np.uint8
        )

    def forget(self) -> None:
        """Drop all remembered pieces: their hashes in order, and the range of each in ``ids``."""
        self.hashes = np.zeros(0, np.uint64)
        self.firsts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.spelled = np.zeros(0, np.uint8)
        self.spell_firsts = np.zeros(0, np.int64)
        self.spell_sizes = np.zeros(0, np.int64)

    def finish(self) -> None:
        """Drop all that was remembered; the worker may go on with other work."""
        self.forget()
        self.v.known_stable.clear()
        self.v._spines.clear()

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces, in byte order so that each goes on from the start it shares with the one before."""
        if len(self.hashes) + len(hashes) > _CACHED_PIECES:
            self.forget()
        found: list[list[int]] = [[]] * len(pieces)
        run, held = Transducer(self.v), b""
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[i]
            if len(held) > self.v.lookahead or len(piece) > self.v.lookahead:
                run, same = Transducer(self.v), 0
            else:
                same = len(os.path.commonprefix([held, piece]))
                run.rewind(same)
            found[i] = run.feed(piece[same:]) + run.finish()
            held = piece
        counts = np.array([len(x) for x in found], np.int64)
        firsts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.firsts = np.concatenate([self.firsts, firsts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        sizes = np.array([len(p) for p in pieces], np.int64)
        spell_firsts = len(self.spelled) + np.cumsum(sizes) - sizes
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(pieces), np.uint8)])
        self.spell_firsts = np.concatenate([self.spell_firsts, spell_firsts])[order]
        self.spell_sizes = np.concatenate([self.spell_sizes, sizes])[order]

    def _misread(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those remembered under their hash."""
        wrong = (ends - begins) != self.spell_sizes[at]
        for first in range(0, len(at), _PIECES_COMPARED):
            same = first + np.flatnonzero(~wrong[first : first + _PIECES_COMPARED])
            own, cuts = ragged(raw, begins, ends - begins, same)
            held, _ = ragged(self.spelled, self.spell_firsts, self.spell_sizes, at[same])
            differs = np.concatenate([[0], np.cumsum(own != held)])
            wrong[same] = differs[cuts[1:]] != differs[cuts[:-1]]
        return np.flatnonzero(wrong)

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens one after another, and where each text's ids start."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.cumsum([0, *map(len, parts)])
        starts = piece_starts(codes, np.unique(sizes[:-1][np.diff(sizes) > 0]))
        wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate([[0], np.cumsum(wide)])
        data = "".join(parts).encode("utf-8", "replace")
        begins, ends = place[starts], place[np.append(starts[1:], len(codes))]
        raw = np.frombuffer(data, np.uint8)
        hashes, first, which = np.unique(
            spans_hash(raw + np.uint64(1), begins, ends), return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            held = len(self.hashes)
            self._learn(hashes[new], [data[begins[i] : ends[i]] for i in first[new].tolist()])
            if len(self.hashes) != held + int(new.sum()):  # others were forgotten
                self.forget()
                self._learn(hashes, [data[begins[i] : ends[i]] for i in first.tolist()])
            at = np.searchsorted(self.hashes, hashes)
        wrong = self._misread(raw, begins, ends, at[which])
        firsts, counts, place, ids = self.firsts, self.counts, at[which], self.ids
        if len(wrong):
            alone = []
            for i in wrong.tolist():
                run = Transducer(self.v)
                alone.append(run.feed(data[begins[i] : ends[i]]) + run.finish())
            sizes_ = np.array([len(x) for x in alone], np.int64)
            place[wrong] = len(firsts) + np.arange(len(wrong))
            firsts = np.concatenate([firsts, len(ids) + np.cumsum(sizes_) - sizes_])
            counts = np.concatenate([counts, sizes_])
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(alone), np.uint32)])
        ids, bounds = ragged(ids, firsts, counts, place)
        return ids.astype("<u4"), bounds[np.searchsorted(starts, sizes)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; special tokens stand for themselves."""
        out = []
        for a, b in slices(texts, _CHARS_AT_ONCE):
            split = [self.specials.split(t) if self.specials else [t] for t in texts[a:b]]
            ids, bounds = self._plain([part for parts in split for part in parts[::2]])
            at = 0
            for parts in split:
                own = []
                for i, part in enumerate(parts):
                    if i % 2:
                        own.append(np.array([self.v.special[part]], "<u4").tobytes())
                    else:
                        own.append(ids[bounds[at] : bounds[at + 1]].tobytes())
                        at += 1
                out.append(b"".join(own))
        return out

    def decode(self, packed: bytes) -> Iterator[str]:
        """Text of packed ids, in parts: a state machine holds back bytes of an unfinished character.

        Bytes that no character has become U+FFFD, ids outside the vocabulary nothing.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        for at in range(0, len(ids), _IDS_AT_ONCE):
            part = ids[at : at + _IDS_AT_ONCE]
            part = part[part < len(self.byte_bounds) - 1]
            data, _ = ragged(self.byte_table, self.byte_bounds[:-1], np.diff(self.byte_bounds), part)
            yield machine.decode(data.tobytes())
        yield machine.decode(b"", True)


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray):
    """The ranges ``values[starts[i]:starts[i] + counts[i]]`` for each i of ``which``, joined, and their bounds."""
    sizes = counts[which]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts[which] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    return Encoder(Vocabulary(path))


@contextlib.contextmanager
def task_encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task. Workers live on, so what it remembers must not outlast the task."""
    own = encoder(path)
    try:
        yield own
    finally:
        own.finish()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids`` (packed little-endian 32-bit) of every whole text of ``doc_id, text``; null is empty.

    The file ``name`` is looked up on each executor. Empty texts have no ids; no rows give no rows; rows that
    repeat an id are encoded each; other columns are ignored.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer_path(name)) as own:
            for batch in batches(found):
                ids = own.encode(batch.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, text`` of packed ids ``doc_id, ids``; null ids give an empty text."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path(name))
        for batch in batches(found):
            rows = ["".join(own.decode(x or b"")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: encoded, then decoded again."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer_path(name)) as own:
            for batch in batches(found):
                out = []
                for ids in own.encode(batch.column("text").fill_null("").to_pylist()):
                    back = hashlib.sha256()
                    for part in own.decode(ids):
                        back.update(part.encode())
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

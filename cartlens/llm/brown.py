"""Language-model scores by Brown classes: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm import words as WD
from cartlens.llm.base import batches, remainder, texts, whole
from cartlens.session import cut_lineage

FOLDS, HELD_OUT = 10, 0
ADD = 0.1
# Words with at least this share of all tokens; so there are at most 2^10 and 2^20 of them.
CLUSTERED_SHARE = 2.0**-10
FREQUENT_SHARE = 2.0**-20
CLASSES = 32
# Words start in a class by their ending; unseen ones and those below the frequent share stay there.
ENDINGS = 32
SWEEPS = 20
# Sweeps over the corpus that put each frequent word outside the core where its neighbours want it.
ASSIGN_SWEEPS = 2
TRANSITION_ADD = 0.5
_END = np.int64(-(1 << 63))
_TEXT_BYTES = 4 << 20
_HELD_PAIRS = 1 << 21


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class by ending and text of each word, A to Z in lower case."""
    low = WD.LOWER[raw]
    found = WD.split(low, offsets)
    last = low[found.ends - 1].astype(np.uint64) if len(found.ends) else np.zeros(0, np.uint64)
    long = found.ends - found.starts > 1
    before = np.where(long, low[found.ends - 2], 0).astype(np.uint64) if len(found.ends) else last
    ending = (WD.mix(last * np.uint64(256) + before, 3) % np.uint64(ENDINGS)).astype(np.int64)
    hashes = found.hashes.view(np.int64).copy()
    hashes[hashes == _END] += 1  # the end's own number
    return hashes, ending, found.rows


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = texts(batch)
    groups = offsets[:-1] // _TEXT_BYTES
    for group in np.unique(groups):
        a, b = (int(np.searchsorted(groups, group, side=side)) for side in ("left", "right"))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the partition with their numbers."""
    held: list[tuple[np.ndarray, ...]] = []
    ends = 0

    def combined():
        h, e, n = (np.concatenate(x) for x in zip(*held))
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        return keys, e[first], np.bincount(which, n, len(keys)).astype(np.int64)

    for batch in batches(found):
        ends += batch.num_rows
        for _, _, raw, offsets in _slices(batch):
            hashes, ending, _ = tokens(raw, offsets)
            keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.append((keys, ending[first], n))
        if len(held) >= 16:
            held = [combined()]
    if ends:
        held.append((np.array([_END]), np.array([0]), np.array([ends])))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in combined()], ["h", "ending", "n"])


def _symbols(hashes: np.ndarray, ending: np.ndarray, clustered: np.ndarray) -> np.ndarray:
    """Place among the clustered words, or behind them the class by ending."""
    at = np.searchsorted(clustered, hashes)
    at[at == len(clustered)] = 0
    hit = clustered[at] == hashes if len(clustered) else np.zeros(len(hashes), bool)
    return np.where(hit, at, len(clustered) + ending)


def _with_ends(symbols: np.ndarray, rows: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``previous, current, row`` of all tokens, each text after and before an end."""
    counts = np.bincount(rows, minlength=n)
    stops = np.cumsum(counts + 1) - 1
    flat = np.full(len(symbols) + n, end, np.int64)
    inner = np.ones(len(flat), bool)
    inner[stops] = False
    flat[inner] = symbols
    return np.concatenate([[end], flat[:-1]]), flat, np.repeat(np.arange(n), counts + 1)


def _pairs(found: Iterator[pa.RecordBatch], clustered: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers of neighbouring classes in the partition; ``of`` gives the class of a symbol, the end's the last."""
    size = int(of[-1]) + 1
    total = np.zeros(size * size, np.int64)
    for batch in batches(found):
        for a, b, raw, offsets in _slices(batch):
            hashes, ending, rows = tokens(raw, offsets)
            before, now, _ = _with_ends(_symbols(hashes, ending, clustered), rows, b - a, len(of) - 1)
            keys, n = np.unique(of[before].astype(np.int64) * size + of[now], return_counts=True)
            total[keys] += n
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])


def _neighbours(found: Iterator[pa.RecordBatch], words: np.ndarray, of: np.ndarray, core: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Classes after and (behind them) before each of ``words`` outside the core: place, class, n.

    Numbers combine within the partition, and leave it whenever there are many.
    """
    kinds = int(of[-1]) + 1
    free = np.concatenate([~core, np.zeros(ENDINGS + 1, bool)])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def combined() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held))
        found, which = np.unique(keys, return_inverse=True)
        return found, np.bincount(which, n, len(found)).astype(np.int64)

    def sent() -> pa.RecordBatch:
        keys, n = held[0]
        return pa.RecordBatch.from_arrays([pa.array(keys // (2 * kinds)), pa.array(keys % (2 * kinds)), pa.array(n)],
                                          ["place", "kind", "n"])

    for batch in batches(found):
        for a, b, raw, offsets in _slices(batch):
            hashes, ending, rows = tokens(raw, offsets)
            before, now, _ = _with_ends(_symbols(hashes, ending, words), rows, b - a, len(of) - 1)
            after, ahead = free[before], free[now]
            keys = np.concatenate([
                before[after] * (2 * kinds) + of[now[after]],
                now[ahead] * (2 * kinds) + kinds + of[before[ahead]],
            ])
            held.append(np.unique(keys, return_counts=True))
            waiting += len(held[-1][0])
            if waiting >= _HELD_PAIRS:
                held = [combined()]
                waiting = len(held[0][0])
                if waiting >= _HELD_PAIRS // 2:
                    yield sent()
                    held, waiting = [], 0
    if waiting:
        held = [combined()]
        yield sent()


def best_classes(numbers: np.ndarray, transition: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """Class of each row of ``numbers[word, class after | class before]`` with the likeliest tokens.

    The classes of the neighbours and the model stay as they are meanwhile. The lowest class among equals.
    """
    kinds = len(transition)
    after, before = numbers[:, :kinds], numbers[:, kinds:]
    gain = after @ transition.T + before @ transition - before.sum(axis=1, keepdims=True) * denominator
    return np.argmax(np.round(gain[:, :-1], 9), axis=1)


def _assigned(found: Iterator[pa.RecordBatch], transition: np.ndarray, denominator: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        lists = {c: batch.column(c) for c in ("kinds", "numbers")}
        owner = np.repeat(np.arange(batch.num_rows), lists["kinds"].value_lengths().to_numpy(zero_copy_only=False))
        numbers = np.zeros((batch.num_rows, 2 * len(transition)))
        numbers[owner, lists["kinds"].flatten().to_numpy()] = lists["numbers"].flatten().to_numpy()
        best = best_classes(numbers, transition, denominator)
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(best)], ["place", "best"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of ``words`` clustered words, from the numbers of neighbouring symbols ``pairs[previous, current]``.

    Words start in classes by turn of frequency. Each is taken out of its class and put where the likelihood of
    the class bigrams is highest, the lowest class among equals, until a sweep moves none. The other symbols
    are classes of their own.
    """
    size = len(pairs)
    order = np.argsort(-pairs[:words].sum(axis=1), kind="stable")
    of = np.concatenate([np.zeros(words, np.int64), np.arange(classes, classes + size - words)])
    of[order] = np.arange(words) % classes
    total = classes + size - words
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    rows, columns = pairs @ member, pairs.T @ member  # [word, class after], [word, class before]
    grid = member.T @ rows
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            own, twin = of[w], pairs[w, w]
            right, left = rows[w].copy(), columns[w].copy()
            right[own] -= twin
            left[own] -= twin
            grid[own] -= right
            grid[:, own] -= left
            grid[own, own] -= twin
            part, side = grid[:classes], grid[:, :classes].T
            gain = (_f(part + right) - _f(part)).sum(axis=1) + (_f(side + left) - _f(side)).sum(axis=1)
            k = np.arange(classes)
            both = right[k] + left[k]
            middle = part[k, k]
            gain += _f(middle + both + twin) + _f(middle) - _f(middle + right[k]) - _f(middle + left[k])
            out, into = part.sum(axis=1), side.sum(axis=1)
            gain -= _f(out + right.sum() + twin) - _f(out) + _f(into + left.sum() + twin) - _f(into)
            best = int(np.argmax(np.where(gain >= gain.max() - 1e-9, 1, 0)))
            if gain[own] >= gain[best] - 1e-9:
                best = own
            grid[best] += right
            grid[:, best] += left
            grid[best, best] += twin
            if best != own:
                moved += 1
                of[w] = best
                rows[:, own] -= pairs[:, w]
                rows[:, best] += pairs[:, w]
                columns[:, own] -= pairs[w]
                columns[:, best] += pairs[w]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """``counts``: h, ending, n of every training token; the arrays are bounded whatever the corpus.

    ``words`` are the frequent words in the order of their hashes, ``words_n`` their numbers. ``of`` holds the class
    of each of them, then of each ending, then of the end.
    """

    counts: DataFrame
    tokens: int
    distinct: int
    words: np.ndarray
    words_n: np.ndarray
    of: np.ndarray
    transition: np.ndarray
    denominator: np.ndarray


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", FOLDS) != HELD_OUT).select(whole().alias("text"))


def _met(rows: DataFrame, words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``[previous, current]`` numbers of neighbouring classes."""
    size = int(of[-1]) + 1
    met = rows.mapInArrow(lambda found: _pairs(found, words, of), "pair long, n long")
    met = met.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(size * size)
    pairs[met["pair"].to_numpy(np.int64)] = met["n"]
    return pairs.reshape(size, size)


def fit_classes(docs: DataFrame, classes: int = CLASSES, sweeps: int = ASSIGN_SWEEPS) -> ClassModel:
    """Learn from ``doc_id, text``: counts of all tokens, classes, and how classes follow one another.

    1. Numbers of words combine within tasks before the shuffle and stay a table. The driver gets only the words
       above a share of all tokens (2^20 at most).
    2. The core, words above a larger share (2^10 at most), is clustered by exchange on the numbers of its
       neighbours (1,057 squared at most).
    3. Every other frequent word is then exchanged by tasks: the classes around it are counted over the whole corpus,
       grouped by word, and it goes to the class, of the core's or of an ending, that makes its tokens likeliest.
       The next sweep counts with the classes of the one before.
    """
    rows = training_rows(docs)
    counts = rows.mapInArrow(_count, "h long, ending long, n long")
    counts = counts.groupBy("h").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))
    counts = cut_lineage(counts, "token-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    known = counts.where(F.col("n") >= max(1.0, FREQUENT_SHARE * n)).toPandas().sort_values("h")
    known = known[known["h"] != _END]
    words, words_n, endings = (known[c].to_numpy(np.int64) for c in ("h", "n", "ending"))
    core = words_n >= CLUSTERED_SHARE * n
    kinds = classes + ENDINGS + 1
    # The symbols of the exchange: words of the core, endings, the end.
    pairs = _met(rows, words[core], np.arange(int(core.sum()) + ENDINGS + 1, dtype=np.int32))
    of = np.arange(len(words) + ENDINGS + 1, dtype=np.int32) - len(words) + classes
    of[: len(words)] = classes + endings
    of[: len(words)][core] = exchange(pairs, int(core.sum()), classes)[: int(core.sum())]
    # Tokens and distinct words of each ending, less those of the frequent words.
    rest = np.zeros((2, ENDINGS))
    other = counts.where(F.col("h") != int(_END)).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in other.collect():
        rest[:, r["ending"]] = r["n"], r["v"]
    np.subtract.at(rest[0], endings, words_n)
    np.subtract.at(rest[1], endings, 1)

    def model(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        transition = np.log10((grid + TRANSITION_ADD) / (grid.sum(axis=1, keepdims=True) + TRANSITION_ADD * kinds))
        held, sorts = np.zeros(kinds), np.zeros(kinds)
        held[classes:-1], sorts[classes:-1] = rest
        np.add.at(held, of[: len(words)], words_n)
        np.add.at(sorts, of[: len(words)], 1)
        return transition, np.log10(held + ADD * (sorts + 1))

    # Outside the core every word is still with its ending, so the core's numbers give the first model.
    member = np.zeros((len(pairs), kinds))
    member[np.arange(len(pairs)), np.concatenate([of[: len(words)][core], np.arange(classes, kinds)])] = 1
    transition, denominator = model(member.T @ pairs @ member)
    for _ in range(sweeps if not core.all() else 0):
        around = rows.mapInArrow(
            lambda found, of=of: _neighbours(found, words, of, core), "place long, kind long, n long"
        )
        # Combined within tasks already, at most two numbers a class and task for each word: one shuffle does.
        around = around.repartition("place").groupBy("place", "kind").agg(F.sum("n").alias("n"))
        around = around.groupBy("place").agg(F.collect_list(F.struct("kind", "n")).alias("met"))
        around = around.select("place", F.col("met.kind").alias("kinds"), F.col("met.n").alias("numbers"))
        best = around.mapInArrow(
            lambda found, t=transition, d=denominator: _assigned(found, t, d), "place long, best long"
        ).toPandas()
        moved = of.copy()
        moved[best["place"].to_numpy(np.int64)] = best["best"]
        if (moved == of).all():
            break
        of = moved
        transition, denominator = model(_met(rows, words, of))
    return ClassModel(counts, n, v, words, words_n, of, transition, denominator)


def _score(found: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Per text all that bounded tables tell, and the words whose number has to be looked up."""
    end = len(model["of"]) - 1
    for batch in batches(found):
        for a, b, raw, offsets in _slices(batch):
            n = b - a
            hashes, ending, rows = tokens(raw, offsets)
            symbols = _symbols(hashes, ending, model["words"])
            before, now, at = _with_ends(symbols, rows, n, end)
            before, now = model["of"][before], model["of"][now]
            score = np.bincount(at, model["transition"][before, now], n)
            kinds = now[now != model["of"][end]]  # of the words, in their order
            hit = symbols < len(model["words"])
            number = np.log10(model["words_n"][symbols[hit]] + ADD)
            known = np.bincount(rows[hit], number, n)
            score += known - np.bincount(rows, model["denominator"][kinds], n)
            count = np.bincount(rows, minlength=n)
            base = known + np.log10(model["ends"] + ADD) - (count + 1) * np.log10(model["all"])
            rare, owner = hashes[~hit], rows[~hit]
            cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, n), pa.array(count + 1),
                    pa.array(np.bincount(rows[hit], minlength=n) + (1 if model["ends"] else 0)),
                    pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )


def score_texts(docs: DataFrame, model: ClassModel) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text of ``doc_id, text``.

    ``score`` is the log10 probability of the text's tokens and its end: for each, the probability of its class
    after the class before, times that of the word within its class, both smoothed. Words below the share of
    frequent ones are looked up by a join with the table of all counts, so no vocabulary is sent to the tasks.
    Null and empty texts have the end as their only token. Rows that repeat a doc_id are scored each; no rows
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({
        "words": model.words, "words_n": model.words_n, "of": model.of,
        "transition": model.transition, "denominator": model.denominator,
        "ends": float((model.counts.where(F.col("h") == int(_END)).agg(F.sum("n")).first()[0]) or 0),
        "all": model.tokens + ADD * (model.distinct + 1),
    })
    rows = docs.select("doc_id", whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(
        lambda x: _score(x, sent.value),
        f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>",
    )
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = found.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    rare = rare.join(model.counts.select("h", "n"), "h", "left")
    number = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(number + ADD)).alias("more"),
        F.sum(F.when(number > 0, F.col("times")).otherwise(0)).alias("seen"),
    )
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + seen).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

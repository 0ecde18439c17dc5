"""Corpus operators against brute force, on small tables full of edge cases."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartlens.llm import bpe, brown, embeddings, exact, language, mixing, near, quality, substring, warc, words
from cartlens.llm.fm_index import FMIndex
from cartlens.llm.graph import components
from cartlens.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, h long, bucket string, score double"


def _documents():
    """Nulls, blanks, copies, near copies, a passage many share, marks, a long text, clashing columns."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [None, "", " \t\n", "one", "One  one\vone", "éü ß 漢字 \x85 \x1c x", "<|endoftext|> a <|endoftext|>", "don't I'll 'sa  \n 's"]
    rows += ["copy of\ta text"] * 5 + ["copy of a  text"]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(30)) + " " + passage + " z" for _ in range(6)]
    for k in range(8):
        changed = list(base)
        changed[k * 7] = "changed"
        rows.append(" ".join(changed))
    rows.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    rows += ["same " * 200, "same " * 300]
    rows += [" ".join(rng.choice(vocabulary) + "!!" for _ in range(40)) for _ in range(12)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(12)]
    sources = ["b", "a", None, "ü", "c"]
    return [(i, t, ["en", "de", None][i % 3], sources[i * i % 5], 1, "x", 0.5) for i, t in enumerate(rows)]


ROWS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def _words(text):
    return (text or "").encode().split()


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def _classes(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_words_do_not_depend_on_their_place():
    texts = [b"", b"a bb", b" bb  a ", b"a", b"\x1c\xc2\x85x"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    found = words.split(raw, np.cumsum([0, *map(len, texts)]))
    assert np.diff(found.bounds).tolist() == [len(t.split()) for t in texts]
    h = found.hashes.tolist()
    assert h[0] == h[3] == h[4] and h[1] == h[2] and len(set(h)) == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 300 + i) for i in range(50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == _classes({x for e in chain for x in e}, chain)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fm_index_counts_windows():
    rng = np.random.default_rng(1)
    passages = [rng.integers(1, 4, size=n) for n in (3, 40, 60, 9, 70)]
    index = FMIndex(passages, np.array([9, 4, 7, 1, 5]), 6)
    first = {}
    for p, owner in zip(passages, [9, 4, 7, 1, 5]):
        for i in range(len(p) - 5):
            key = tuple(p[i : i + 6])
            first[key] = min(first.get(key, 99), owner)
    strange = rng.integers(1, 6, size=50)
    for p, found in zip([*passages, strange], index.least_owners([*passages, strange])):
        want = [first.get(tuple(p[i : i + 6]), np.iinfo(np.int64).max) for i in range(len(p) - 5)]
        assert found.tolist() == want


@pytest.mark.parametrize("shard_words", [300_000, 100])
def test_substring(spark, docs, nothing, shard_words):
    first, want = {}, {}
    for i, text, *_ in ROWS:
        w = _words(text)
        mark = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                mark[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        want[i] = (len(w), sum(mark), hashlib.sha256(kept).hexdigest())
    got = _by_id(substring.repeated_passages(docs, shard_words=shard_words))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 500
    if shard_words == 100:
        assert substring.repeated_passages(nothing).count() == 0


def test_substring_keeps_ids_exact(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(1000)}" for _ in range(n)]
    shared, other, low = text(80), text(80), (1 << 62) + 1
    parts = {None: text(9) + shared + text(9) + other + text(9), low: text(9) + shared + text(9), low + 1: text(9) + other + text(9)}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in parts.items()], "doc_id long, text string")
    got = _by_id(substring.repeated_passages(frame))
    assert {i: r.n_removed for i, r in got.items()} == {None: 160, low: 0, low + 1: 0}
    parts = {(1 << 62) + k: text(9) + shared + text(9) for k in range(4)}
    rows = [*((i, " ".join(t)) for i, t in parts.items()), (None, " ".join(text(9) + shared))]
    got = _by_id(substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.n_removed for i, r in got.items()} == {None: 80} | {i: 80 * (i > 1 << 62) for i in parts}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    near_by = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.2, 0.3, 0.31, 0.32)]
    vectors = [v.tolist() for v in near_by] + [near_by[0].tolist()] * 30 + [None, [], [0.0] * 16, [math.nan] * 16, [1.0, 2.0], [2.0, 4.0], [1e200] + [0.0] * 15, [1e-200] + [0.0] * 15]
    vectors.append([None] + [1.0] * 15)
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string, rep int")
    links = collections.Counter()
    pairs = []
    usable = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(vectors[i]) / np.abs(vectors[i]).max() for i in usable}
    for x in usable:
        for y in usable:
            if x < y and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] / math.sqrt((unit[x] @ unit[x]) * (unit[y] @ unit[y])) >= 0.95:
                links[x] += 1
                links[y] += 1
                pairs.append((x, y))
    low = _classes(range(len(vectors)), pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame, tile_rows=7).collect()}
    assert got == {i: (links[i], low[i], low[i] == i) for i in range(len(vectors))}
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_quantised_products_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)) + 2.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embeddings.tile_links(unit, unit, 0.9, True)
    want = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert sorted(zip(i, j)) == sorted(zip(*want)) and len(i)


def test_exact(spark, docs, nothing):
    groups = collections.defaultdict(list)
    body = {}
    for i, text, *_ in ROWS:
        body[i] = "".join(" " if c in " \t\n\v\f\r" else c for c in text or "")
        while "  " in body[i]:
            body[i] = body[i].replace("  ", " ")
        groups[body[i]].append(i)
    got = _by_id(exact.exact_groups(docs, capacity=5))
    for i, r in got.items():
        own = groups[body[i]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), i == min(own))
        assert r.text_sha256 == hashlib.sha256(body[i].encode()).hexdigest()
    assert len(got) == len(ROWS)
    kept = exact.drop_exact(docs.unionAll(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact.exact_groups(nothing).count() == 0


def test_directory_splits_only_full_buckets():
    found = exact.directory({0: 10, 1: 10, exact.SLOTS - 1: 1}, 15)
    assert [s for s, _, _ in found] == list(range(exact.SLOTS))
    assert found[0][1:] == (0, exact.DIRECTORY_BITS) and found[1][1] == 1 and found[-1][2] == 1


def _labels(spark):
    return spark.createDataFrame([(i, 0 if "!!" in (t or "") else 1, 0) for i, t, *_ in ROWS if i > 20], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, nothing):
    weights = quality.fit_quality(docs, _labels(spark))
    got = _by_id(quality.score_quality(docs, weights))
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in got if i >= len(ROWS) - 24 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i].score < 0.5) == (i < len(ROWS) - 12) for i in held)
    assert quality.score_quality(docs, quality.fit_quality(docs, _labels(spark).limit(0))).first().score == 0.5
    assert quality.score_quality(nothing, weights).count() == 0


def test_language(spark, docs, nothing):
    said = {"en": "the house and the garden ", "de": "das haus und der garten ", "fr": "la maison et le jardin "}
    rows = [(i, said[k] * (i % 3 + 1), k) for i, k in enumerate(list(said) * 40)]
    rows += [(1000, None, "en"), (1001, " 12 !", "de"), (1002, "haus und garten", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = _by_id(language.identify(frame, language.fit_language(frame)))
    assert all(got[i].lang_pred == k and got[i].score > 0.5 for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und", "und", "de"]
    assert language.identify(frame, language.fit_language(nothing)).first().lang_pred == "und"


def test_near(spark, docs, nothing):
    bags = {}
    for i, text, *_ in ROWS:
        w = _words(text)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])
    links = []
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                shared = sum((bags[a] & bags[b]).values())
                if shared >= 0.8 * (bags[a].total() + bags[b].total() - shared):
                    links.append((a, b))
    low = _classes(bags, links)
    size = collections.Counter(low.values())
    got = _by_id(near.near_groups(docs).members)
    assert {i: (r.group_id, r.group_size) for i, r in got.items()} == {i: (low[i], size[low[i]]) for i in bags}
    assert max(size.values()) >= 6
    kept = near.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))
    assert near.near_groups(nothing).members.count() == 0


def test_drop_near_keeps_a_row_of_each_class(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (None, c), (None, c + " more"), (None, d), (None, e), (7, e + " more"), (7, e + " more"),
            (None, None), (None, ""), (3, " "), (3, "\t"), (3, b + " x")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bag int")
    kept = collections.Counter((r.doc_id, r.text) for r in near.drop_near(frame).collect())
    either = collections.Counter(r for r in kept if r[0] is None and (r[1] or "").startswith(c))
    assert either.total() == 1 and set(either) <= {(None, c), (None, c + " more")}
    want = [(1, a), (2, b), (None, d), (7, e + " more"), (None, None), (None, ""), (3, " "), (3, "\t")]
    assert kept - either == collections.Counter(want)


def test_near_joins_classes_of_one_bucket_across_tiles(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(70):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            text[at] = f"x{i}-{at}"
        copies.append((i, " ".join(text)))
    bags = {i: collections.Counter(tuple(t.split()[k : k + 5]) for k in range(116)) for i, t in copies}
    links = []
    for a, b in itertools.combinations(bags, 2):
        shared = sum((bags[a] & bags[b]).values())
        if shared >= 0.8 * (232 - shared):
            links.append((a, b))
    low = _classes(bags, links)
    assert len(set(low.values())) > 3
    frame = spark.createDataFrame(copies, "doc_id long, text string")
    for tile_shingles in (1 << 19, 1500):
        got = near.near_groups(frame, tile_shingles=tile_shingles)
        assert {r.doc_id: r.group_id for r in got.members.collect()} == low
        assert got.links.count() < len(links)


def test_signatures_estimate_weighted_jaccard():
    h = np.arange(1, 301, dtype=np.uint64)
    a, b = np.ones(300, np.int64), np.ones(300, np.int64)
    a[:20], b[:20], b[200:] = 9, 5, 1
    a, b = a[:250], b
    sign = near.signatures(np.concatenate([h[:250], h]), np.repeat([0, 1], [250, 300]), np.concatenate([a, b]), 2, 4000)
    want = np.minimum(a, b[:250]).sum() / (np.maximum(a, b[:250]).sum() + b[250:].sum())
    assert abs((sign[0] == sign[1]).mean() - want) < 0.04


def _pages(spark):
    rows = [(5, "http://a/ü\r\nX: y", "<p>1"), (3, None, "<p>1"), (9, "http://b", None), (8, "http://c", ""), (7, "d", "é" * 5000),
            (None, "e", "<p>2"), (11, "f", "<p>2"), (12, "f", "WARC/1.1\r\n\r\n\r\n")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int"), rows


def test_substring_with_many_rows_alike(spark):
    """Rows without an id that repeat one text cost no more than their number."""
    rng = random.Random(12)
    text = [f"v{rng.randrange(5000)}" for _ in range(2000)]
    body = " ".join(text)
    mixed = " ".join([*text[:700], "other", *text[900:1500], *[f"u{k}" for k in range(40)]])
    rows = [(None, body)] * 3000 + [(7, mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring.repeated_passages(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    covered = 700 + 600
    assert {tuple(r) for r in got} == {(None, 2000, covered, 3000), (7, len(mixed.split()), 0, 1)}


def test_warc(spark):
    pages, rows = _pages(spark)
    files = []
    for parts in (1, 4):
        folder = scratch_path(spark, "warc")
        manifest = warc.write_warc(pages.repartition(parts), folder, shard_bytes=4000, file_bytes=900)
        files.append(sorted(map(tuple, manifest.collect())))
        got = {r.page_id: r for r in warc.read_warc(spark, manifest, folder).collect()}
        for page_id, _, html in rows:
            payload = (html or "").encode()
            r = got[page_id]
            assert r.payload_bytes == len(payload) and r.payload_digest == warc.payload_digest(payload)
            refers = {5: 3, 9: 8, None: 11}.get(page_id)
            assert (r.record_type, r.refers_to) == ("revisit" if refers else "response", refers)
            assert r.payload == (None if refers else payload)
    assert files[0] == files[1] and len(files[0]) > 2
    folder = scratch_path(spark, "warc")
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), folder), folder).count() == 0


def test_warc_writes_its_manifest_beside_the_files(spark):
    pages, _ = _pages(spark)
    folder = scratch_path(spark, "warc")
    manifest = warc.write_warc(pages, folder, shard_bytes=4000, file_bytes=900)
    assert sorted(map(tuple, spark.read.parquet(folder + "/manifest").collect())) == sorted(map(tuple, manifest.collect()))


def test_warc_bounds_take_as_many_jobs_for_many_shards_as_for_few(spark):
    rng = random.Random(8)
    sizes = [(k * k - 10**9 * (k % 3), rng.choice([1, 40, 100, 900])) for k in range(10_000)]
    sizes += [(sizes[5][0], 70)] * 3
    rows = spark.createDataFrame(sizes, "key long, bytes long").repartition(5)
    of = collections.Counter()
    for key, n in sizes:
        of[key] += n
    jobs = []
    for shard_bytes in (20, 2_000_000):
        running, want, last = 0, [], None
        for key in sorted(of):
            if running // shard_bytes != last:
                last = running // shard_bytes
                want.append(key)
            running += of[key]
        spark.sparkContext.setJobGroup(f"bounds-{shard_bytes}", "bounds")
        assert warc.shard_bounds(rows, shard_bytes) == want
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bounds-{shard_bytes}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert warc.shard_bounds(rows.limit(0)) == []


def test_warc_keeps_ids_exact(spark):
    top = (1 << 63) - 1
    rows = [(top - 2, "a", "<p>1"), (top, "b", "<p>1"), (None, "c", "<p>1"), (top - 1, "d", "<p>2"), (-top, "e", "<p>2"), (None, "f", "<p>3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    folder = scratch_path(spark, "warc")
    got = warc.read_warc(spark, warc.write_warc(pages, folder), folder).collect()
    want = {"a": (top - 2, None), "b": (top, top - 2), "c": (None, top - 2), "d": (top - 1, -top), "e": (-top, None), "f": (None, None)}
    assert {r.url: (r.page_id, r.refers_to) for r in got} == want and len(got) == len(rows)


def test_bpe(spark, docs, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = _by_id(bpe.digests(docs))
    back = _by_id(bpe.decode_ids(bpe.encode_texts(docs)))
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and back[i].text == decoded
    assert bpe.digests(nothing).count() == 0


def test_transducer_keeps_a_bounded_window():
    vocabulary = bpe.encoder(bpe.tokenizer_path()).v
    run, out, widest = bpe.Transducer(vocabulary), [], 0
    data = b"abcabdthethe  == ing" * 400
    for at in range(0, len(data), 50):
        out += run.feed(data[at : at + 50])
        widest = max(widest, len(run.text))
    assert out + run.finish() == vocabulary.merged(data) and widest <= 6 * vocabulary.lookahead


def test_brown(spark, docs, nothing):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*_words(t and t.encode().translate(low).decode()), None] for i, t, *_ in ROWS}
    counts = collections.Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for x in t)
    n, v = counts.total(), len(counts)
    got = _by_id(brown.score_texts(docs, brown.fit_classes(docs)))
    for i, t in tokens.items():
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9, abs_tol=1e-9) and got[i].score < 0
    assert brown.score_texts(nothing, brown.fit_classes(nothing)).count() == 0
    assert brown.score_texts(docs, brown.fit_classes(nothing)).count() == len(ROWS)


def test_brown_scores_by_its_classes(spark, docs):
    """Every frequent word is in the class that its neighbours ask for; scores are those of the classes, token by token."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [x.translate(low) for x in _words(t)] for i, t, *_ in ROWS}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    fitted = brown.fit_classes(docs, sweeps=1)
    start = brown.fit_classes(docs, sweeps=0)
    raw = np.frombuffer(b" ".join(sorted({x for t in tokens.values() for x in t})), np.uint8)
    hashes, ending, _ = brown.tokens(raw, np.array([0, len(raw)]))
    ids = dict(zip(sorted({x for t in tokens.values() for x in t}), zip(hashes.tolist(), ending.tolist())))
    place = {h: k for k, h in enumerate(fitted.words.tolist())}
    end = brown.CLASSES + brown.ENDINGS

    def model(of):
        kind = {x: int(of[place[h]]) if h in place else brown.CLASSES + e for x, (h, e) in ids.items()}
        grid, count, held, sorts = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
        for i in train:
            path = [end, *[kind[x] for x in tokens[i]], end]
            grid.update(zip(path, path[1:]))
            count.update(tokens[i])
        for x, n in count.items():
            held[kind[x]] += n
            sorts[kind[x]] += 1
        out = collections.Counter()
        for (a, _), n in grid.items():
            out[a] += n
        step = lambda a, b: math.log10((grid[a, b] + 0.5) / (out[a] + 0.5 * (end + 1)))
        emit = lambda x: math.log10((count[x] + 0.1) / (held[kind[x]] + 0.1 * (sorts[kind[x]] + 1)))
        weight = lambda k: math.log10(held[k] + 0.1 * (sorts[k] + 1))
        return kind, count, step, emit, weight

    kind, count, step, emit, _ = model(fitted.of)
    got = _by_id(brown.score_texts(docs, fitted))
    for i, t in tokens.items():
        path = [end, *[kind[x] for x in t], end]
        score = sum(step(a, b) for a, b in zip(path, path[1:])) + sum(emit(x) for x in t)
        assert math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-9)
    # The sweep, word by word, from the classes before it.
    kind, count, step, _, weight = model(start.of)
    around = collections.defaultdict(list)
    for i in train:
        path = [end, *[kind[x] for x in tokens[i]], end]
        for k, x in enumerate(tokens[i], 1):
            around[x].append((path[k - 1], path[k + 1]))
    moved = 0
    for x, n in count.items():
        at = place[ids[x][0]]
        if n >= brown.CLUSTERED_SHARE * fitted.tokens:
            assert fitted.of[at] == start.of[at] < brown.CLASSES
            continue
        gains = [sum(step(a, c) + step(c, b) for a, b in around[x]) - n * weight(c) for c in range(end)]
        assert gains[fitted.of[at]] >= max(gains) - 1e-6
        moved += fitted.of[at] != start.of[at]
    assert moved > 10
    assert set(fitted.words.tolist()) == {ids[x][0] for x in count}


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 3, size=12)
    pairs = rng.poisson(2 + 30 * (kind[:, None] == (kind[None, :] + 1) % 3)).astype(float)

    def likelihood(of):
        grid = np.zeros((6, 6))
        np.add.at(grid, (of[:, None], of[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    of = brown.exchange(pairs, 9, classes=3)
    assert of[9:].tolist() == [3, 4, 5]
    for w in range(9):
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(of) + 1e-6
    start = np.append(np.arange(9) % 3, [3, 4, 5])
    assert likelihood(of) > likelihood(start)


def test_mixing(spark, docs, nothing):
    size = {i: len(_words(t)) for i, t, *_ in ROWS}
    source = {i: s for i, _, _, s, *_ in ROWS}
    names = sorted({s for s in source.values() if s is not None}, key=lambda s: s.encode()) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, wanted = set(), 1.5 * sum(total.values())
    while True:
        level = (wanted - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * total[s] if s in capped else level * weight[s] for s in names}
    mixed = mixing.mix(docs, block_words=64)
    got = _by_id(mixed.taken)
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]]) and 0 <= r["taken"] <= 2 * size[i]
        assert math.isclose(r["target"], target[source[i]], rel_tol=1e-9)
    for s in names:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[s]) <= 1
    again = _by_id(mixing.mix(docs.repartition(7), block_words=64).taken)
    assert again == got and len(got) == len(ROWS)
    assert mixing.mix(nothing).taken.count() == 0
    # Pieces of a block follow one another and hold the words the documents give.
    words_of = collections.Counter()
    for r in mixed.pieces.collect():
        words_of[r["doc_id"]] += r["end"] - r["begin"]
    assert all(words_of[i] == r["taken"] for i, r in got.items())
    # Every prefix of the schedule holds about each source's share.
    order = [r["place"] for r in mixed.schedule.orderBy("slot").collect()]
    for place in set(order):
        share = order.count(place) / len(order)
        assert all(abs(order[:k].count(place) - k * share) < 6 for k in range(0, len(order), 25))


def test_take_mixed(spark, docs):
    taken = _by_id(mixing.mix(docs).taken)
    kept = mixing.take_mixed(docs)
    assert kept.columns == docs.columns
    times = collections.Counter(r.doc_id for r in kept.collect())
    want = {i: math.floor(r["taken"] / max(r["size"], 1) + 0.5) for i, r in taken.items()}
    assert all(times[i] == n for i, n in want.items())


def test_take_pieces(spark, docs):
    taken = _by_id(mixing.mix(docs).taken)
    kept = corpus_pipeline.mix_sources(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.defaultdict(list)
    for r in kept.collect():
        got[r.doc_id].append(r.text)
    for i, text, *_ in ROWS:
        rows = sorted(got[i], key=len)
        assert sum(len(_words(t)) for t in rows) == taken[i]["taken"]
        assert all(t == text for t in rows[1:]) and all(text.startswith(t) for t in rows)
    # One document that is a third of all words and wanted 0.4 times is there with its words.
    rows = [(1, " ".join(f"a{i}" for i in range(300)), "a"), *((k, " ".join(f"b{i}" for i in range(100)), "b") for k in range(2, 8))]
    frame = spark.createDataFrame([*rows, (2, rows[1][1], "b"), (None, "x", None)], "doc_id long, text string, source string")
    want = {r["source"]: r["words"] for r in mixing.mix(frame, weights=(1.0, 5.0), share=0.7).sources.collect()}
    words = collections.Counter()
    for r in mixing.take_pieces(frame, weights=(1.0, 5.0), share=0.7).collect():
        words[r.source] += len(_words(r.text))
    assert 0 < want["a"] < 150 and {k: n for k, n in want.items() if n} == words

"""The pipeline's stages one after another, each against its own operator or brute force."""

import gc
import hashlib

import corpus_pipeline
import pyarrow as pa
from cartlens.llm import bpe

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], FOLDER).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    good, exact, near, mixed = ([r.asDict() for r in f.collect()] for f in frames[1:5])
    assert 0 < len(good) < docs.count()
    bodies = {" ".join((r["text"] or "").encode().decode("latin-1").split(" ")) for r in exact}
    assert len(exact) == len(bodies) <= len(good)
    ids = {r["doc_id"] for r in near}
    assert len(ids) == len(near) and ids <= {r["doc_id"] for r in exact}
    assert {r["doc_id"] for r in mixed} <= ids
    own = bpe.encoder(bpe.tokenizer_path())
    want = sorted((r["doc_id"], hashlib.sha256(own.encode([r["text"]])[0]).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, r.ids_sha256) for r in frames[-1].collect()) == want


def test_workers_keep_no_encoder(spark):
    """What the encoder holds ends with its task, so later stages in the same Python workers start without it."""
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(8)
    assert bpe.digests(docs).count() == bpe.decode_ids(bpe.encode_texts(docs)).count() == 64

    def held(found):
        for batch in found:
            kept = [o for o in gc.get_objects() if isinstance(o, bpe.Encoder) and len(o.hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {0}

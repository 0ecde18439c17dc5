"""The corpus operators as named queries over the sample tables, and SQL for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import (
    alignment, bpe, brown, embeddings, exact, language, mixing, near, quality, substring, toxicity, warc, whitening
)
from cartlens.llm.base import remainder, table
from cartlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(make):
    QUERIES[make.__name__] = make
    return make


@_query
def op3_exact(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


@_query
def op4_quality(spark, folder):
    docs = table(spark, folder, "documents")
    weights = quality.fit_quality(docs, table(spark, folder, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        (remainder("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"),
    )


@_query
def op5_language(spark, folder):
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit_language(docs))
    held = (remainder("doc_id", language.FOLDS) == language.HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")


@_query
def op1_substring(spark, folder):
    return substring.repeated_passages(table(spark, folder, "documents"))


@_query
def op2_embeddings(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@_query
def op6_near(spark, folder):
    return near.near_groups(table(spark, folder, "documents")).members.drop("bag")


@_query
def op7_warc(spark, folder):
    archive = scratch_path(spark, "warc")
    manifest = warc.write_warc(table(spark, folder, "pages"), archive)
    return warc.read_warc(spark, manifest, archive).drop("url", "payload")


@_query
def op8_bpe(spark, folder):
    return bpe.digests(table(spark, folder, "documents"))


@_query
def op9_brown(spark, folder):
    docs = table(spark, folder, "documents")
    found = brown.score_texts(docs, brown.fit_classes(docs))
    held = (remainder("doc_id", brown.FOLDS) == brown.HELD_OUT).alias("held_out")
    return found.select("doc_id", held, *found.columns[1:])


@_query
def op10_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).taken.drop("source", "body")


@_query
def op11_alignment(spark, folder):
    return alignment.link_sums(table(spark, folder, "documents"))


@_query
def op12_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    examples = toxicity.fit_examples(docs, table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), examples)
    return scored.select(
        "doc_id",
        (remainder("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.PREDICT).cast("int").alias("predicted"),
        F.col("evidence.doc_id").alias("evidence"),
    )


@_query
def op13_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


ORACLES["op3_exact"] = r"""
with texts as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
), groups as (
    select body, min(doc_id) as keep_id, count(*) as group_size from texts group by body
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
from texts join groups using (body)
"""

ORACLES["op7_warc"] = r"""
with rows as (
    select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages
), bits as (
    select page_id, payload, [instr('0123456789abcdef', hex[i + 1]) - 1 for i in range(40)] as h from rows
), coded as (
    select page_id, payload, array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([
            ((h[((5 * j + k) // 4) + 1] >> (3 - (5 * j + k) % 4)) & 1) * (1 << (4 - k)) for k in range(5)])::int, 1)
        for j in range(32)], '') as digest
    from bits
), firsts as (
    select payload, min(page_id) as first_id from rows group by payload
)
select page_id, octet_length(encode(payload))::bigint as payload_bytes, digest as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to
from coded join firsts using (payload)
"""

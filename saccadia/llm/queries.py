"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, doc_fingerprint, hard_negatives, html_blocks, language_id, lm_score, near_dup, piece_codec, repeats, spelling,
               token_files, topk_search)
from .common import to_hex


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.near_duplicate_components(_table(spark, folder, "documents"), width=4, radius=4)
    return found.select("doc_id", to_hex("fp").alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return doc_fingerprint.fingerprints(_table(spark, folder, "documents"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Target part: the documents labelled as good."""
    good = _table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(_table(spark, folder, "documents"), good)


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removal_digest(_table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encode(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(_table(spark, folder, "conversations"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of vectors whose id 7 divides are moved on by one first."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, folder, "embeddings"), moved, n_positives=5, k=3, least_pct=50, most_pct=95, every=50)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"), least_length=7, least_count=2, hurt_every=31, ratio=10)


def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.nearest(_table(spark, folder, "embeddings"), k=5, every=50)


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_document_fingerprints, op3_lm_scoring, op4_suffix_array_dedup, op5_token_files,
    op6_decontamination, op7_html_extraction, op8_language_id, op9_sentencepiece, op10_chat_formatting, op11_hard_negatives, op12_spelling_variants, op13_exact_topk)}

_VECTORS = """vectors as (
    select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""

_TOP_K = f"""
with {_VECTORS}, scored as (
    select q.vec_id as query_id, r.vec_id, list_inner_product(q.v, r.v)::bigint as score
    from vectors q join vectors r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5"""

_HARD_NEGATIVES = f"""
with {_VECTORS}, labelled as (
    select vec_id, v, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from vectors where label is not null),
scored as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
    from labelled a join labelled r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3"""

#: crc32 byte by byte: a table of the remainders of all bytes, then one step per byte of the text written in hexadecimal.
_SPELLING = """
with crc_table as (
    select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
lowered as (
    select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
    from runs where length(run) >= 7 group by all),
hexed as (select *, hex(encode(id || ':' || run)) as x from lowered),
hashed as (
    select run, n, xor(4294967295, list_reduce(
        list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) as h
    from hexed, crc_table),
words as (
    select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word,
        sum(n)::bigint as n
    from hashed group by 1 having length(word) >= 7 and sum(n) >= 2),
holes as (select word, n, unnest(range(length(word))) as k from words),
cut as (select word, n, substr(word, 1, k) as a, substr(word, k + 2) as b from holes),
pairs as (
    select x.word, x.n, y.word as near, y.n as near_n from cut x join cut y on x.a = y.a and x.b = y.b and x.word <> y.word
    union select c.word, c.n, w.word, w.n from cut c join words w on w.word = c.a || c.b
    union select w.word, w.n, c.word, c.n from cut c join words w on w.word = c.a || c.b),
best as (
    select word, n, near, near_n, count(*) over (partition by word) as n_near from pairs
    qualify row_number() over (partition by word order by near_n desc, near) = 1),
forms as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near end as form,
        case when near_n >= 10 * w.n then near_n end as form_n
    from words w left join best b on b.word = w.word),
steps as (
    with recursive s as (
        select word, word as root, 0 as depth from forms
        union all select s.word, f.form, depth + 1 from s join forms f on f.word = s.root where f.form is not null)
    select word, arg_max(root, depth) as root from s group by word)
select f.word, form, root, n, n_near, form_n from forms f join steps using (word)"""

SQL: dict[str, str] = {"op10_chat_formatting": chat.SQL, "op11_hard_negatives": _HARD_NEGATIVES, "op12_spelling_variants": _SPELLING,
                       "op13_exact_topk": _TOP_K}

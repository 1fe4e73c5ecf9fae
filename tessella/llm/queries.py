"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, classifier, near, packing, pii, quality_rules, secrets, substring, topk
from tessella.llm.common import read_table
from tessella.llm.token_store import TokenStore
from tessella.llm.tokens import BYTE_FILE, WORD_FILE


def op1_huffman_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TokenStore(spark, public_tokenizers.path(WORD_FILE), end_id=2).write(read_table(spark, sf_dir, "documents"))
    return store.read().drop("ids")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE), end_id=0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_rules.judged(read_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read_table(spark, sf_dir, "documents"))


def op5_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedupe(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op7_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_huffman_token_store, op2_best_fit_packing, op3_quality_rules, op4_pii_disclosure, op5_relative_lz_dedup, op6_secret_scan, op7_bottom_k_near_dedup, op8_fourier_quality, op9_threshold_top_k, op10_segment_tree_bpe)
}

#: DuckDB. The others depend on a tokenizer, an automaton, a fitted model or a transitive closure and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        p as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
        s as (select r, unnest(range(1, len(w) - 3)) as i, w from p where len(w) >= 5),
        g as (select r, i, array_to_string(w[i:i+4], ' ') as k from s),
        m as (select r, k from g group by r, k having count(*) > 1),
        h as (select distinct g.r, unnest(range(g.i, g.i + 5)) as i from g join m on g.r = m.r and g.k = m.k),
        c as (select r, count(*) as n from h group by r),
        q as (select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                     len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(list_distinct(w)) as n_distinct,
                     length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations, length(regexp_replace(t, '\P{L}', '', 'g')) as n_letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) as n_upper
              from p left join c using (r)),
        f as (select *, cast(n_words < 10 as bigint) + 2 * cast(100 * n_repeat_words > 20 * n_words as bigint) + 4 * cast(10 * n_symbols > n_words as bigint)
                     + 8 * cast(n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines as bigint) + 16 * cast(n_upper > 20 and 2 * n_upper > n_letters as bigint)
                     + 32 * cast(5 * n_exclamations > n_words as bigint) + 64 * cast(word_chars > 20 * n_words as bigint)
                     + 128 * cast(n_words >= 10 and 4 * n_distinct < n_words and n_distinct * n_distinct < 16 * n_words as bigint)
                     + 256 * cast(2 * n_letters < word_chars as bigint) as failures from q)
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
               cast(n_repeat_words as bigint) as n_repeat_words, failures % 4 > 0 as base_failed, failures = 0 as kept, failures from f
    """,
    "op9_threshold_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify rank <= 10
    """,
    "op5_relative_lz_dedup": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from d where len(w) >= 13),
        g as (select doc_id, i, array_to_string(w[i:i+12], ' ') as k from s),
        m as (select k, min(doc_id) as least from g group by k),
        h as (select distinct g.doc_id, unnest(range(g.i, g.i + 13)) as i from g join m using (k) where m.least < g.doc_id),
        c as (select doc_id, count(*) as n from h group by doc_id),
        p as (select d.doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
        t as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept from p left join h on p.doc_id = h.doc_id and p.i = h.i where h.i is null group by p.doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256, f.factors
        from d left join c using (doc_id) left join t using (doc_id) left join (
            select doc_id, string_agg(a || ':' || n, ',' order by a) as factors from (
                select doc_id, min(i) - 1 as a, count(*) as n from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as r from h) group by doc_id, r) group by doc_id) f0(doc_id, factors0) using (doc_id)
        cross join lateral (select coalesce(f0.factors0, '') as factors) f
    """,
}

"""The corpus pipeline: rejected documents go, near duplicates go, repeated passages go, personal data go, the rest is packed.

Every stage takes and, but for the last, returns the columns of its input, whatever their names. A null text has no words, so the quality rules
reject it, as they do an empty one; a null doc_id stays null and its row is decided by its text. Of rows with equal doc_id and text
one stays; other ties go to the smallest doc_id. An empty table stays empty through all stages. Texts are taken whole, however long."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import near, packing, pii, quality_rules, substring
from tessella.llm.common import Scratch, read_table
from tessella.llm.tokens import BYTE_FILE

#: Near duplicates share 0.8 of their five-word shingles; the 85 that ``near`` assumes is op7's.
NEAR_PERCENT = 80


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduped(docs, NEAR_PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cleaned(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(BYTE_FILE), end_id=0)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", remove_personal_data),
    ("packing", pack_sequences),
]

#: Tokens and best-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet to the shared folder and read again by the next; then what the stage and the one before it wrote goes."""
    scratch, docs, last = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        opened = len(Scratch.opened)
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        Scratch.drop_since(opened)
        if last:
            scratch.drop(last)
        last = name
    return docs

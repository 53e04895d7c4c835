"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns a DataFrame, which is written as
Parquet and read again before the next. All but the last keep the columns of ``documents``:

1. ``language``: documents whose language can't be identified go.
2. ``toxicity``: documents scored 0.7 or more go.
3. ``near_duplicates``: one document of each SimHash group stays, that of the smallest id.
4. ``mixing``: documents are repeated or left out so that sources meet their target weights.
5. ``sentencepiece``: piece ids of every text, and its best segmentations.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemara.llm import langid, mixing, nbest, simhash, toxicity
from mnemara.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs, docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", sentencepiece),
]

#: Training, hashing and search have no form in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline over `documents`: one operator per stage, each stage on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.decontaminate import Budget, drop_leaks
from utilscope.llm.language_id import keep_identified
from utilscope.llm.ngram_join import Similarity, one_of_each
from utilscope.llm.piece_bpe import encode_texts
from utilscope.llm.shipping import ship
from utilscope.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = Similarity(words=5, numerator=80, denominator=100)
BUDGET = Budget(q=10, percent=8)
MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; `lang` counts as declared, `source` as the host."""
    ship(spark)
    return keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return one_of_each(docs.select(*COLUMNS), NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), BUDGET)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, token `ids` (with begin and end) and the `decoded` text of every document."""
    ship(spark)
    return encode_texts(docs, public_tokenizers.path(MODEL), ["doc_id"])


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("tokens", tokens),
]

#: SQL has neither the fitted language model nor the vocabulary; tests hold a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

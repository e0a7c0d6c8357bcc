"""The corpus pipeline: documents in, packed training sequences out, one written table between stages.

Every stage but the last returns the columns of ``documents`` for the rows that stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase.llm import near, packing, pii, quality, toxicity
from clearcase.llm.common import table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that compress like toxic text; learnt from all labelled ones."""
    return toxicity.filtered(docs, toxicity.trained(docs, table(spark, sf_dir, "labels"), held=-1))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose posterior quality is low; learnt from all labelled ones that are left."""
    return quality.filtered(docs, quality.trained(docs, table(spark, sf_dir, "labels"), held=-1))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates; rows without an id stay."""
    found = near.near_duplicates(docs)
    return docs.join(found.filter(~F.col("kept")).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs, "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left; few words are kept, as the stages before share the workers and their memory."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), memo=packing.MEMO_SMALL)


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good),
    ("near_duplicates", distinct),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Compression, tokenizing and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

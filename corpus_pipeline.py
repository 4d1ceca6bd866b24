"""The corpus pipeline (part of subpackage llm): from raw documents to token ids.

Stages, each applied to all that the one before kept: toxic documents go; of each group of near copies one document stays;
documents that hold a benchmark item go; the rest is encoded to token ids and decoded back. Between stages the documents
are written as Parquet in the shared folder and read again.

Null, empty and blank texts are no one's copies, hold no item and no toxic word, and go through to the end as no tokens. Rows
are judged by id and text: rows of one id with different texts each stay, of equal rows and of near copies one stays, whatever
their ids; a row without id goes where a copy with one stays. An empty table gives an empty table. All but the last stage carry
every column of documents along, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe_codec, decontaminate, ngram_join, toxicity
from lodestrata.llm._common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays under the cut, learned from the labels of these documents that are not held out."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of shingle Jaccard 0.75 or more, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold less than 0.75 of the shingles of every benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and the text decoded from them."""
    return bpe_codec.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe_codec", encode),
]

#: A learned score and an encoder are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: five stages, each one operator, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bpe, line_dedup, mixing, simhash, toxicity
from docweft.llm.common import with_checkpoints


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labelled ones among them, scores below one half.

    A null text scores as an empty one; rows without key are scored and not learned from; repeated rows stay or go together;
    without labels of both classes nothing goes; an empty table gives no rows. All columns stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model, at=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has or nearly has.

    Null texts stay null; rows that share a key, or have none, count as one document, so repeated rows keep the same lines;
    an empty table gives no rows. All columns stay.
    """
    return line_dedup.deduplicate(docs, k=1, min_chars=24)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest doc_id.

    Null and empty texts are one group; a row without key stays only where its whole group has none; of repeated rows one
    stays; an empty table gives no rows. All columns stay.
    """
    return simhash.one_of_each(docs, width=3, seed=42, bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for every lap in which the mix takes words of them.

    Texts without words, null ones too, take no part; a null source is a source, the last; rows without key take part;
    repeated rows lie side by side; an empty table gives no rows. All columns stay.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to, as digests.

    A null text is an empty one, without ids; repeated rows and rows without key come out as they came in; an empty table
    gives no rows.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, decode=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Not all stages can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them lie in the checkpoint folder.

    What each stage does with nulls, empty texts, ties and repeated rows is its function's; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

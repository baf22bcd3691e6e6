"""Where conversions go: documents as lines of JSON, diagnostics, and the gate on losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LOSSES = ("lossy", "unsupported")


class LossError(RuntimeError):
    """Something was lost that the caller wanted kept."""


def write_documents(documents: DataFrame, path: str, json: str = "json") -> None:
    """One document a line; the order of documents is not kept."""
    documents.select(F.col(json).alias("value")).write.text(path)


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """One diagnostic a line, with its details as an object."""
    diagnostics.write.json(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a file that holds one JSON object; a name that is there twice has the value that comes first by code points."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("name", "value"))
    return pairs.groupBy("name").agg(F.min("value").alias("value"))


def refuse_losses(diagnostics: DataFrame) -> DataFrame:
    """The diagnostics, if none is a loss; else LossError, which names how many there are by code."""
    lost = diagnostics.where(F.col("severity").isin(*LOSSES)).groupBy("code").count().orderBy("code").collect()
    if lost:
        raise LossError(", ".join(f"{r['code']}: {r['count']}" for r in lost))
    return diagnostics

"""Continuous conversion of exchange documents to target documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweft.operators import forward
from docweft.plans.session import with_checkpoints
from docweft.sources.nodes import flatten


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, ast) of the JSON lines that arrive in a folder."""
    return spark.readStream.schema("doc string, ast string").json(folder)


def convert_stream(arriving: DataFrame, out: str, checkpoint: str, symbols: dict[str, str] | None = None) -> StreamingQuery:
    """Convert (doc, ast) as they come, until what is there is done: `out` gets the folders documents and errors.

    A batch is written under its own number in place of what an attempt before it left, so a document comes out once
    even if an executor or the driver is lost between. A batch without rows writes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        nodes, errors = flatten(batch)
        keep = lambda df, name: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        keep(forward.convert(nodes, symbols), "documents")
        keep(errors, "errors")

    with_checkpoints(arriving.sparkSession)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

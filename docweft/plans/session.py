"""Sessions: the settings that the engine expects, and the package on every worker."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: What goes between the executor and its Python workers at a time: Spark's default, and what serves rows that hold whole texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", f"{1 << 20}b")}


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: its sources go out once a Spark application, through Spark's file server."""
    with_small_batches(spark)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Make Arrow batches smaller, where the session leaves them at Spark's default.

    The buffers of large ones stay with the executor, which has to have room for its Python workers too.
    """
    for key, (default, ours) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make checkpoint() usable: the folder that the cluster names, or one in the warehouse where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return spark


def saved(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


def once(make):
    """make(*args), which builds columns, built once a Spark application: a large expression takes thousands of calls to the JVM."""
    found: dict = {}

    def get(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in found:
            found[key] = make(*args)
        return found[key]

    return get


def kept_in_place(df: DataFrame, key: str = "doc") -> DataFrame:
    """df computed once, as a bucketed Parquet table in the checkpoint folder: joins and windows on its key and anything else move nothing.

    Columns are packed, and later plans read those that they need. Where df's rows lie by key already, each task writes one file.
    The table's name is given back at once; its files stay as those of a checkpoint do.
    """
    spark = with_checkpoints(df.sparkSession)
    name = f"docweft_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    # A task has one bucket, and needn't sort its rows by it; what the job shuffled is of no use once its table is there.
    ours = {"spark.sql.maxConcurrentOutputFileWriters": "4", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").options(path=folder, compression="zstd").saveAsTable(name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def by_document(df: DataFrame, made: Callable[[DataFrame], DataFrame], key: str = "doc") -> DataFrame:
    """What `made` makes of df, saved with all rows of a document in one partition, so that joins and windows on its key and anything else move nothing.

    df is dealt out by key, and `made` has to leave rows in the partition that they come from. A document's rows have to fit a task.
    There are as many partitions as spark.sql.shuffle.partitions says.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return kept_in_place(made(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)), key)

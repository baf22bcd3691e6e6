"""Whitening of embeddings from a tiled covariance.

Dimensions are cut into tiles, and pairs of tiles are the keys of the covariance. Rows go in row blocks; a row block's
columns travel in column blocks, one a tile, which meet again by row block; each pair of column blocks is multiplied, the
products are summed by tile pair, and the tiles make up the matrix whose eigenvectors are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import small_batches, with_small_batches
from docweft.llm.topk import scaled

MOST_DIMS = 4096  #: the covariance of so many dimensions, 128 MB, is assembled on the driver
MOST = 1 << 40  #: components beyond this are refused: their square has no exact double
SMALL = 1e-12  #: eigenvalues up to this part of the trace count as none


def grid(column: pa.Array, dims: int, fill: float, dtype) -> np.ndarray:
    """Lists as the rows of one array, with fill where a list is short."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.full((len(column), dims), fill, dtype)
    out[np.arange(dims) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def moments(rows: DataFrame, fill: float) -> tuple[int, np.ndarray]:
    """Number of vectors in column v, and the sum of each dimension; a shorter vector counts as filled up.

    Each task adds up what it has, so what reaches the driver is a row a dimension. Sums of integers are exact.
    """
    kind = rows.schema["v"].dataType.elementType
    whole = isinstance(kind, T.LongType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, tops, n = (np.zeros(0, np.int64 if whole else float), np.zeros(0, np.int64), np.zeros(0), 0)
        for batch in batches:
            column = batch.column("v")
            dims = max(len(sums), int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            here = grid(column, dims, 0, sums.dtype)
            sums, counts, tops = (np.pad(a, (0, dims - len(a))) for a in (sums, counts, tops))
            sums = sums + here.sum(0)
            counts = counts + (np.arange(dims) < np.diff(column.offsets.to_numpy())[:, None]).sum(0)
            tops = np.maximum(tops, np.abs(here).max(0, initial=0))
            n += batch.num_rows
        arrays = [np.arange(-1, len(sums)), np.append(sums[:0], [0, *sums]).astype(sums.dtype), np.append(n, counts), np.append(0.0, tops)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["dim", "total", "n", "top"])

    parts = rows.select("v").mapInArrow(add, f"dim long, total {kind.simpleString()}, n long, top double")
    found = {r.dim: r for r in parts.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top")).collect()}
    n = found[-1].n if -1 in found else 0
    dims = max(found, default=-1) + 1
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions; at most {MOST_DIMS}")
    if whole and n * max((r.top for r in found.values()), default=0) >= 2**62:
        raise OverflowError(f"sums of {n} vectors leave 64 bits")
    return n, np.array([found[d].total + type(found[d].total)(fill) * (n - found[d].n) for d in range(dims)], np.int64 if whole else float)


def covariance(rows: DataFrame, n: int, mean: np.ndarray, fill: float, tile: int = 32, block_bytes: int = 1 << 21) -> np.ndarray:
    """Covariance of column v over all rows, divisor n, centred before multiplying.

    A row block has at most block_bytes of doubles (one row at least); a task holds the sums of its tile pairs, which are as large as the result.
    """
    dims = len(mean)
    if not n or not dims:
        return np.zeros((dims, dims))
    tiles = -(-dims // tile)
    most = max(1, block_bytes // (8 * dims))

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in small_batches(batch, most):
                centred = grid(part.column("v"), dims, fill, float) - mean
                cells = [np.ascontiguousarray(centred[:, d : d + tile]).tobytes() for d in range(0, dims, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * tiles), pa.array(range(tiles), pa.int32()), pa.array(cells, pa.binary())], ["row_block", "part", "cells"])
                name += 1

    def widths(i: int) -> int:
        return min(tile, dims - i * tile)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
                product = np.frombuffer(a).reshape(-1, widths(i)).T @ np.frombuffer(b).reshape(-1, widths(j))
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        for (i, j), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("total")[0].as_py()) // 8)
        for b in table.column("total"):
            total += np.frombuffer(b.as_py())
        return pa.table({"i": table.column("i")[:1], "j": table.column("j")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    blocks = rows.select("v").mapInArrow(column_blocks, "row_block long, part int, cells binary")
    met = blocks.groupBy("row_block").agg(F.sort_array(F.collect_list(F.struct("part", "cells"))).alias("blocks"))
    keys = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda i: F.transform(F.sequence(i, F.lit(tiles - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    pairs = met.select("blocks", keys.alias("tile")).select("tile.i", "tile.j", F.col("blocks")[F.col("tile.i")].cells.alias("a"), F.col("blocks")[F.col("tile.j")].cells.alias("b"))
    products, shape = pairs.mapInArrow(multiply, "i int, j int, total binary"), "i int, j int, total binary"
    some = products.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("i", "j", "share").applyInArrow(add, shape)
    matrix = np.zeros((dims, dims))
    for row in some.groupBy("i", "j").applyInArrow(add, shape).toLocalIterator():
        at, beside = row.i * tile, row.j * tile
        cells = np.frombuffer(bytes(row.total)).reshape(widths(row.i), widths(row.j)) / n
        matrix[at : at + cells.shape[0], beside : beside + cells.shape[1]] = cells
        matrix[beside : beside + cells.shape[1], at : at + cells.shape[0]] = cells.T
    return matrix


def principal(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of equal sign at every run; none beyond the matrix's rank."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    order = [i for i in order if values[i] > SMALL * np.trace(matrix)]
    vectors = vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(len(order))] if len(order) else np.zeros(0)
    return values[order], vectors * np.where(top < 0, -1, 1)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, by: int = 1024, shift: int = 100_000, tile: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    x = floor(by * c) + shift for each entry c. Vectors that are null, or hold null or non-finite entries, take no part; a
    shorter vector counts as filled up with entries 0, also one without entries. Rows of null key, of one key, and equal rows each count and
    come out. A direction in which the vectors don't differ (an eigenvalue of at most 1e-12 of the trace) is no component, so
    equal vectors, a single one, or an empty table give no rows. deviation is exact, as a decimal. Entries beyond 2^40, and sums that leave
    62 bits, fail the job. vectors must be a stored table or another input whose rows don't change between reads.
    """
    with_small_batches(vectors.sparkSession)
    fine = F.forall(F.col(vector), lambda c: F.abs(c) < MOST)
    value = F.when(fine, F.transform(scaled(F.col(vector), by), lambda x: x + F.lit(shift).cast("long"))).otherwise(F.raise_error(F.lit("an entry is beyond 2^40")).cast("array<bigint>"))
    rows = vectors.select(F.col(key).alias("key"), F.when(scaled(F.col(vector), by).isNotNull(), value).alias("v")).where("v IS NOT NULL")
    n, sums = moments(rows, shift)
    mean = sums / max(n, 1)
    matrix = covariance(rows, n, mean, shift, tile)
    values, axes = principal(matrix, components)
    scale, dims, trace = np.sqrt(values), len(sums), float(np.trace(matrix))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grid(batch.column("v"), dims, shift, np.int64)
            off = n * x - sums
            if dims * float(np.abs(off).max(initial=0)) ** 2 >= 2**62:
                off = off.astype(object)
            deviation = pa.array((off * off).sum(1).tolist(), pa.decimal128(38)) if off.dtype == object else pa.array((off * off).sum(1)).cast(pa.decimal128(38))
            made = (x - mean) @ axes / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(values), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), deviation, lists], ["key", "deviation", "v"])

    schema = T.StructType([rows.schema["key"], T.StructField("deviation", T.DecimalType(38)), T.StructField("v", T.ArrayType(T.DoubleType()))])
    projected = rows.mapInArrow(project, schema)
    error = 0.0
    if len(values):
        _, totals = moments(projected, 0.0)
        error = float(np.abs(covariance(projected, n, totals / n, 0.0, tile) - np.eye(len(values))).max())
    explained = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    out = projected.select("key", "deviation", F.posexplode("v").alias("at", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )

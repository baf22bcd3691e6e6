"""Logistic regression over hashed binary features, fitted by Spark jobs on a bounded sample.

A row's features are the sorted bucket numbers it has, as little-endian unsigned 32-bit integers. The sample is packed and
checkpointed once; each round broadcasts the weights of the buckets in use, adds up one gradient a task, and releases them.
Rows never reach the driver, and a round's plan is a scan and one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import saved

#: Rows that are packed together; what a task holds at a time.
PACK = 128
TYPES = {"y": "<f8", "sizes": "<i4", "flat": "<u4"}

Pack = tuple[np.ndarray, np.ndarray, np.ndarray]  #: labels, numbers of features, features


def packed(rows: DataFrame, tasks: int = 8) -> DataFrame:
    """Packs of the rows' (y, idx), in a fixed number of partitions: what the rounds send to the driver is bounded too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                idx = [np.frombuffer(b, "<u4") for b in part.column("idx").to_pylist()]
                yield _row((part.column("y").to_numpy(zero_copy_only=False), np.array([len(i) for i in idx]), np.concatenate(idx)))

    return saved(rows.select("y", "idx").coalesce(tasks).mapInArrow(run, ", ".join(f"{c} binary" for c in TYPES)))


def _row(pack: Pack) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in zip(pack, TYPES.values(), strict=True)], list(TYPES))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for batch in batches:
        for blobs in zip(*(batch.column(c) for c in TYPES), strict=True):
            yield tuple(np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, TYPES.values(), strict=True))


def sums(packs: DataFrame, each: Callable[[Pack], list[np.ndarray]], n: int) -> list[np.ndarray] | None:
    """The sums over all packs of the n arrays that each() gives, as float64; None without any pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for pack in _packs(batches):
            got = each(pack)
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.astype("<f4").tobytes()], pa.binary()) for t in total], [f"s{i}" for i in range(n)])

    found = packs.mapInArrow(run, ", ".join(f"s{i} binary" for i in range(n))).collect()
    return [np.sum([np.frombuffer(r[i], "<f4") for r in found], axis=0, dtype=float) for i in range(n)] if found else None


def rows_of(sizes: np.ndarray) -> np.ndarray:
    """The row of each feature."""
    return np.repeat(np.arange(len(sizes)), sizes)


def log_count_ratios(packs: DataFrame, dims: int, alpha: float = 2.0, errors: float = 2.0) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket: how much likelier rows with y = 1 have it than rows with y = 0.

    Ratios shrink towards zero by `errors` of their standard errors, so a bucket that few rows have counts for nothing.
    The classes share the smoothing by what they hold in all, else a bucket that no row has would speak for the smaller.
    """

    def each(pack: Pack) -> list[np.ndarray]:
        y, sizes, flat = pack
        of = y[rows_of(sizes)]
        return [np.bincount(flat, of, dims), np.bincount(flat, 1 - of, dims)]

    found = sums(packs, each, 2)
    return np.zeros(dims, np.float32) if found is None else shrunk_ratios(*found, alpha, errors)


def shrunk_ratios(p: np.ndarray, q: np.ndarray, alpha: float, errors: float) -> np.ndarray:
    """See log_count_ratios(); p, q: rows of class 1 and 0 that have each bucket."""
    share = p.sum() / max(p.sum() + q.sum(), 1)
    p, q = p + alpha * share, q + alpha * (1 - share)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio, error = np.log((p / p.sum()) / (q / q.sum())), np.sqrt(1 / p + 1 / q)
    return np.nan_to_num(np.sign(ratio) * np.maximum(np.abs(ratio) - errors * error, 0), posinf=0, neginf=0).astype(np.float32)


def only(packs: DataFrame, used: np.ndarray, dims: int) -> DataFrame:
    """The packs with the used buckets alone, under their places in `used`."""
    place = np.full(dims, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, sizes, flat in _packs(batches):
            now = place[flat]
            keep = now >= 0
            yield _row((y, np.bincount(rows_of(sizes)[keep], minlength=len(sizes)), now[keep]))

    return saved(packs.mapInArrow(run, packs.schema))


def fit(packs: DataFrame, dims: int, scale: np.ndarray | None = None, rounds: int = 30, l2: float = 1e-2, step: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by bucket (times scale) and bias; y may be soft, 0 to 1. Adam on the full sample.

    A bucket of scale 0 has no gradient, so only the others are looked at.
    """
    used = np.arange(dims) if scale is None else np.flatnonzero(scale)
    scale = np.ones(dims) if scale is None else scale[used].astype(float)
    mine = packs if len(used) == dims else only(packs, used, dims)
    n, context = len(used), packs.sparkSession.sparkContext
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        sent = context.broadcast(((w[:-1] * scale).astype(np.float32), w[-1]))

        def each(pack: Pack, sent=sent) -> list[np.ndarray]:
            y, sizes, flat = pack
            of, (weights, bias) = rows_of(sizes), sent.value
            off = logistic(np.bincount(of, weights[flat], len(sizes)) + bias) - y
            return [np.bincount(flat, off[of], n), np.array([off.sum(), len(y)])]

        found = sums(mine, each, 2)
        sent.destroy()
        if found is None or found[1][1] == 0:
            break
        w, m, v = adam(w, m, v, np.append(found[0] * scale, found[1][0]) / found[1][1], l2, t, step * (1 - t / (rounds + 1)))
    out = np.zeros(dims, np.float32)
    out[used] = w[:-1] * scale
    return out, float(w[-1])


def adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, l2: float, t: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and moments after round t; the last weight, the bias, has no penalty."""
    grad = grad + l2 * np.append(w[:-1], 0.0)
    m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
    return w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8), m, v


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sample_of_each_class(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` keys (columns key, y) of each of the classes 0 and 1, those whose hash is least."""
    taken = [labels.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(most) for y in (0, 1)]
    return taken[0].union(taken[1])

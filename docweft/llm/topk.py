"""Exact top-k by inner product: columnar branch-and-bound over blocks of vectors.

Candidates lie in vertical layout, one array a dimension. Scores are added up one block of dimensions at a time; after
each block the candidates whose score plus the most that the other dimensions can add stays below the query's k-th best
go, and the survivors are compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import copied, saved

STEP = 8  #: dimensions in a block


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component x as double; null for a vector that is null or holds a null or non-finite one."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double"))))


def columns_of(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as the columns of one array, zeros below the shorter ones; float64 where sums stay exact, else int64."""
    dims = max(map(len, vectors), default=0)
    out = np.zeros((dims, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def norms_left(columns: np.ndarray) -> np.ndarray:
    """By block of dimensions: the length of what each vector has from that block on; a last row of zeros."""
    squares = [np.square(columns[d : d + STEP].astype(float)).sum(0) for d in range(0, len(columns), STEP)]
    left = np.cumsum(squares[::-1], axis=0)[::-1] if squares else np.zeros((0, columns.shape[1]))
    return np.sqrt(np.vstack([left, np.zeros((1, columns.shape[1]))]))


def search(
    query: np.ndarray, query_left: np.ndarray, columns: np.ndarray, left: np.ndarray, alive: np.ndarray, k: int, floor_: float
) -> tuple[np.ndarray, np.ndarray]:
    """(score, place) of those of the `alive` columns that may be among the query's k best, given that k others reach floor_.

    The bound on what is left is the product of lengths (Cauchy-Schwarz), widened by its rounding.
    """
    shared = min(len(query), len(columns))
    query, columns = query[:shared], columns[:shared]
    scores = np.zeros(len(alive), columns.dtype)
    seeds = alive[:64]
    if len(seeds) >= k:
        full = query @ columns[:, seeds]
        floor_ = max(floor_, np.partition(full, len(full) - k)[len(full) - k])
    for b, d in enumerate(range(0, shared, STEP)):
        scores = scores + query[d : d + STEP] @ columns[d : d + STEP, alive]
        most = scores + (query_left[b + 1] * left[b + 1, alive] * (1 + 1e-9) + 1e-6)
        keep = most >= floor_
        if not keep.all():
            alive, scores = alive[keep], scores[keep]
        if not len(alive):
            break
    return scores, alive


FACTS = ("ids", "names", "copies", "asks")  #: of each vector in a pack


def packed(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, name, n, asks, v) in packs of at most `most`: facts and vectors, as columns of one array, in bytes."""
    for at in range(0, batch.num_rows, most):
        part = batch.slice(at, most)
        values = part.column("v")
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
        grid = columns_of([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        facts = [part.column(c).to_numpy() for c in ("id", "name", "n", "asks")]
        arrays = [pa.array([int(facts[1][0])]), pa.array([grid.shape[0]], pa.int32()), *[pa.array([f.tobytes()], pa.binary()) for f in (*facts, grid)]]
        yield pa.RecordBatch.from_arrays(arrays, ["first", "dims", *FACTS, "grid"])


class Share:
    """Candidates of one share: ids, names and copies, their vectors as columns, and what `search` wants to know of them."""

    def __init__(self, packs: list[tuple[np.ndarray, ...]]):
        self.ids, self.names, self.copies = (np.concatenate([p[i] for p in packs]) for i in range(3))
        grids = [p[-1] for p in packs]
        dims = max(map(len, grids))
        self.whole = np.hstack([np.pad(g, ((0, dims - len(g)), (0, 0))) for g in grids])
        self.most = max(dims, 1) * float(np.abs(self.whole).max(initial=1))
        self.fine, self.left = self.whole.astype(float), norms_left(self.whole)

    def best(self, query_id: int, name: int, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(id, score, copies) of the k best for a query, ties to the smaller id."""
        grid = self.fine if self.most * float(np.abs(q).max(initial=1)) < 2**52 else self.whole
        q_left = norms_left(np.pad(q, (0, max(len(q), len(grid)) - len(q)))[:, None])[:, 0]
        others = self.copies - ((self.ids == query_id) & (self.names == name))
        scores, places = search(q.astype(grid.dtype), q_left, grid, self.left, np.flatnonzero(others), k, -np.inf)
        for i in np.lexsort((self.ids[places], -scores))[:k]:
            yield int(self.ids[places[i]]), int(scores[i]), min(int(others[places[i]]), k)


def exact_top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, by: int = 256, block: int = 512, queries: int = 512, spread: int = 48, share_bytes: int = 1 << 25
) -> DataFrame:
    """(query_id, rank, key, score): the k highest integer inner products of every query with all other rows.

    is_query, over vectors, picks the queries. Vectors of null key, or null, or holding null or non-finite components take
    no part; a shorter vector counts as filled up with zeros. Every row but the query's own is a candidate, rows that repeat
    its key or are equal to it too; ties go to the smaller key. A query row that is there twice gives its answer twice.
    Rows equal in key and vector are one candidate with a number, so results don't depend on their order. Candidates go in
    packs of at most `block` to one of `spread` shares or more, so many that one has about share_bytes; queries go in packs of
    at most `queries` to every share. A share holds its candidates and answers each query as it comes, with k rows; so the
    candidates are shuffled once, nothing is joined, and neither a row nor the driver has to hold more as the table grows.
    """
    usable = vectors.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), by).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = saved(usable.groupBy("id", "v").agg(F.count("*").alias("n"), F.count_if("q").alias("asks")).withColumn("name", F.xxhash64("id", "v")))
    cells = rows.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    spread = max(spread, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * cells // share_bytes))
    kinds = "first long, dims int, " + ", ".join(f"{c} binary" for c in (*FACTS, "grid"))

    def packs(some: DataFrame, most: int) -> DataFrame:
        return some.select("id", "name", "n", "asks", "v").mapInArrow(lambda batches: (p for b in batches for p in packed(b, most)), kinds)

    offered = packs(rows, block).withColumn("share", F.pmod(F.xxhash64("first"), F.lit(spread)).cast("int")).withColumn("asking", F.lit(False))
    asked = packs(rows.where("asks > 0"), queries).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("asking", F.lit(True))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, share = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["share"] != at:
                    at, waiting, share = row["share"], [], None
                ids, names, copies, asks = (np.frombuffer(row[c], np.int64) for c in FACTS)
                grid = np.frombuffer(row["grid"], np.int64).reshape(row["dims"], len(ids))
                if not row["asking"]:
                    waiting.append((ids, names, copies, grid))
                    continue
                if waiting:
                    share, waiting = Share(waiting), []
                if share is not None:
                    found = [(int(i), int(m), int(n), *near) for i, m, n, q in zip(ids, names, asks, grid.T, strict=True) for near in share.best(i, m, q, k)]
                    columns = list(zip(*found, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "name", "asks", "id", "score", "copies"])

    met = offered.unionByName(asked).repartition(spread, "share").sortWithinPartitions("share", "asking")
    near = copied(met.mapInArrow(probe, "query_id long, name long, asks long, id long, score long, copies long"), "copies", "copy")
    order = Window.partitionBy("query_id", "name").orderBy(F.col("score").desc(), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    answers = copied(ranked.select("query_id", "rank", "id", "score", "asks"), "asks", "again")
    return answers.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS pos, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
scored AS (
  SELECT q.pos, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.pos <> c.pos WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

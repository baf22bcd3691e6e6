"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm import linear
from docweft.llm.common import keyed, numbered_columns, text_pass

DIMS = 1 << 18
SIZES = (3, 4, 5)
#: Characters looked at together; a longer text is gone over in windows that overlap by a gram, so memory is bounded.
WINDOW = 1 << 20


class Grams:
    """The buckets of a text's character n-grams, each once, sorted."""

    def __init__(self, dims: int = DIMS, sizes: tuple[int, ...] = SIZES):
        self.dims, self.sizes, self.seen = dims, sizes, np.zeros(dims, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        padded = f" {' '.join((text or '').lower().split())} "
        for at in range(0, len(padded), WINDOW):
            codes = np.frombuffer(padded[at : at + WINDOW + max(self.sizes) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            hashed = codes.copy()
            for n in range(2, max(self.sizes) + 1):
                if len(codes) < n:
                    break
                hashed = hashed[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
                if n in self.sizes:
                    mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
                    self.seen[((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(8) & np.uint32(self.dims - 1)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class ToxicityModel:
    """A weight for each bucket, and a bias; tells is false for a model that had no rows of a class to learn from."""

    weights: np.ndarray
    bias: float
    tells: bool = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        grams = Grams(len(self.weights))
        return linear.logistic(np.array([self.bias + self.weights[grams(t)].sum(dtype=float) for t in texts]))


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 4000
) -> ToxicityModel:
    """A model from labelled rows; may_learn, over docs, says which rows may be learned from.

    The sample is bounded: at most `most` labelled keys of each class, those with the least hash of the key; a key with
    several labels counts as 1 if one of them is, and a key with several texts gives its least. Rows without key or
    label are not learned from. With no rows of a class the score is the classes' share, 0.5 without any label.
    """
    learnable = docs if may_learn is None else docs.where(may_learn)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    ids = learnable.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    known = known.join(ids, "key", "left_semi")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        p = next(iter(shares), 0.5)
        return ToxicityModel(np.zeros(DIMS, np.float32), float(np.log(max(p, 1e-3) / max(1 - p, 1e-3))), tells=False)
    chosen = linear.sample_of_each_class(known, most)
    texts = keyed(learnable, key, text).join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    grams = lambda batch: [pa.array([g.astype("<u4").tobytes() for g in map(Grams(), batch)], pa.binary())]
    rows = text_pass(texts.repartition("key"), [T.StructField("idx", T.BinaryType())], grams).select(F.col("y").cast("double"), "idx")
    packs = linear.packed(rows)
    weights, bias = linear.fit(packs, DIMS, linear.log_count_ratios(packs, DIMS), l2=1e-3)
    taken = [min(shares[y], most) for y in (0, 1)]
    return ToxicityModel(weights, bias + float(np.log(shares[1] / shares[0]) - np.log(taken[1] / taken[0])))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text (0 to 1) added as the last column; a column of that name gives way to it.

    A null text scores as an empty one; repeated rows come out as they came in; an empty table gives no rows.
    """
    rows, names = numbered_columns(docs)
    scored = text_pass(rows, [T.StructField("score", T.DoubleType())], lambda texts: [pa.array(model.scores(texts))], names[text], keep=True)
    return scored.select(*[F.col(new).alias(old) for old, new in names if old != into], F.col("score").alias(into))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of docs that score below `at`, with the columns of docs, whatever their names.

    A model that had no rows of a class to learn from can't tell them apart, and rejects nothing. Null and empty texts score alike; repeated rows stay or go together; null keys play no part; an empty table gives no rows.
    """
    if not model.tells:
        return docs
    rows, names = numbered_columns(docs)
    scored = text_pass(rows, [T.StructField("score", T.DoubleType())], lambda texts: [pa.array(model.scores(texts))], names[text], keep=True)
    return scored.where(F.col("score") < at).select(*[F.col(new).alias(old) for old, new in names])

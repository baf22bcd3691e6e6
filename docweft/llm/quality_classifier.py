"""Quality classifier from weak labels: expectation-maximisation weighs heuristic labellers, their posterior labels train a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm import linear
from docweft.llm.common import keyed, saved, text_pass
from docweft.llm.quality_rules import measured, rules
from docweft.llm.weak import VoteModel, fit_votes, log_odds

DIMS = 1 << 16
WINDOW = 1 << 20
_CLASS = np.arange(128, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = ord("a"), ord("A"), ord("0")


class Shapes:
    """Buckets of a text: n-grams of its characters' classes, and its word statistics in steps. Language plays no part."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.seen = dims, np.zeros(dims, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        for at in range(0, max(len(text), 1), WINDOW):
            codes = np.frombuffer(text[at : at + WINDOW + 3].encode("utf-32-le", "surrogatepass"), np.uint32)
            shape = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint32(ord("a")))
            hashed = shape.copy()
            for n in range(1, 5):
                if n > 1:
                    hashed = hashed[:-1] * np.uint32(0x9E3779B1) + shape[n - 1 :]
                if len(hashed):
                    mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
                    self.seen[(mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(8) & np.uint32(self.dims - 1)] = True
                if len(shape) <= n:
                    break
        words = text.split()
        n = len(words)
        named = [f"words {n.bit_length()}"]
        if n:
            lines = text.split("\n")
            named += [f"distinct {min(n.bit_length(), 10)} {20 * len(set(words)) // n}", f"length {4 * sum(map(len, words)) // n}"]
            named += [f"upper {10 * sum(map(str.isupper, words)) // n}", f"lines {10 * len(set(lines)) // len(lines)}"]
            named += [f"adjacent {20 * sum(a == b for a, b in zip(words, words[1:], strict=False)) // n}"]
        self.seen[[xxhash.xxh32_intdigest(s) % self.dims for s in named]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class QualityModel:
    """The label model, and the scorer trained on its posteriors."""

    votes: VoteModel
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        shapes = Shapes(len(self.weights))
        return linear.logistic(np.array([self.bias + self.weights[shapes(t)].sum(dtype=float) for t in texts]))


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, VoteModel]:
    """(key, posterior) for every row by the labellers' votes, and their model. A text without words is bad: 0."""
    rows = saved(measured(docs, key, text))
    votes = {f"vote_{k}": v for k, v in rules().items()}
    voted = rows.select("key", "n_words", *[v.alias(k) for k, v in votes.items()])
    model = fit_votes(voted.where("n_words > 0"), list(votes))
    good = F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-log_odds(model)))).otherwise(0.0)
    return voted.select("key", good.alias("posterior")), model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3000) -> tuple[QualityModel, DataFrame]:
    """The model, and the posterior label of every row as (key, posterior).

    The label model sees all rows. The scorer is trained on at most `most` rows of each class of the posterior, those
    with the least hash of the key; rows without key are left out, of rows with one key the least posterior and text
    count. With no rows of a class the scorer gives the prior.
    """
    posterior, votes = labelled(docs, key, text)
    known = posterior.where("key IS NOT NULL").groupBy("key").agg(F.min("posterior").alias("p"))
    split = known.select("key", (F.col("p") >= 0.5).cast("int").alias("y"), "p")
    shares = {r["y"]: r["count"] for r in split.groupBy("y").count().collect()}
    if len(shares) < 2:
        return QualityModel(votes, np.zeros(DIMS, np.float32), float(np.log(votes.prior / (1 - votes.prior)))), posterior
    taken = [split.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(most) for y in (0, 1)]
    chosen = taken[0].union(taken[1]).select("key", F.col("p").alias("y"))
    texts = keyed(docs, key, text).join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    shapes = lambda batch: [pa.array([s.astype("<u4").tobytes() for s in map(Shapes(), batch)], pa.binary())]
    rows = text_pass(texts.repartition("key"), [T.StructField("idx", T.BinaryType())], shapes).select("y", "idx")
    weights, bias = linear.fit(linear.packed(rows), DIMS, rounds=40)
    counts = [min(shares[y], most) for y in (0, 1)]
    return QualityModel(votes, weights, bias + float(np.log(shares[1] / shares[0]) - np.log(counts[1] / counts[0]))), posterior


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """(key, score, kept) for every row: probability of good quality of the whole text, and whether it reaches `at`.

    Null and empty texts are scored like texts without words; repeated rows and null keys come out as they came in; an
    empty table gives no rows.
    """
    scored = text_pass(keyed(docs, key, text), [T.StructField("score", T.DoubleType())], lambda texts: [pa.array(model.scores(texts))])
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= at).alias("kept"))

"""A label model: the reliabilities of voters that may abstain, by expectation-maximisation over vote patterns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of a voter's answers: bad, abstains, good.
ANSWERS = (-1, 0, 1)


@dataclass
class VoteModel:
    """prior: share of good rows; given[class][voter][answer]: how often a voter answers so, classes bad and good."""

    voters: list[str]
    prior: float
    given: np.ndarray


def fit_votes(rows: DataFrame, voters: list[str], rounds: int = 50, smooth: float = 1.0) -> VoteModel:
    """The model of rows whose columns `voters` hold -1, 1 or null.

    Rows are counted by pattern in Spark; the driver sees a count for each pattern, 3 to the number of voters at most.
    Voters start as right in most votes, so that good means what most of them call good. Without rows that start stays.
    """
    counted = rows.groupBy(*[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in voters]).count().collect()
    start = np.array([[[0.4, 0.4, 0.2]] * len(voters), [[0.05, 0.45, 0.5]] * len(voters)])
    model = VoteModel(voters, 0.8, start)
    if not counted:
        return model
    table = np.array([[r[v] + 1 for v in voters] for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    order = np.lexsort(table.T)
    table, counts = table[order], counts[order]
    for _ in range(rounds):
        good = pattern_posterior(model, table)
        weights = np.stack([counts * (1 - good), counts * good])
        given = np.full((2, len(voters), 3), smooth)
        for c in (0, 1):
            for v in range(len(voters)):
                given[c, v] += np.bincount(table[:, v], weights[c], 3)
        model = VoteModel(voters, float((weights[1].sum() + 1) / (counts.sum() + 2)), given / given.sum(-1, keepdims=True))
    return model


def pattern_posterior(model: VoteModel, table: np.ndarray) -> np.ndarray:
    """P(good) of each pattern; table has a voter's answer, 0 to 2, in each column."""
    logs = np.log(model.given)
    odds = np.log(model.prior / (1 - model.prior)) + sum(logs[1, v][table[:, v]] - logs[0, v][table[:, v]] for v in range(table.shape[1]))
    return 1 / (1 + np.exp(-odds))


def log_odds(model: VoteModel) -> Column:
    """The model's log odds of good as an expression over the voters' columns."""
    total = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for v, name in enumerate(model.voters):
        bad, none, good = (float(x) for x in np.log(model.given[1, v]) - np.log(model.given[0, v]))
        total = total + F.when(F.col(name) == -1, bad).when(F.col(name) == 1, good).otherwise(none)
    return total

"""The fitted models against plain versions: dense counts, dense gradients, and expectation-maximisation row by row."""

import math
import random


import numpy as np
import pytest

from docweft.llm import linear, quality_classifier, quality_rules, toxicity, weak
from tests.llm.test_operators import docs, empty, labelled_texts, text  # noqa: F401

RNG = random.Random(11)


def sample(spark, n=60, dims=40):
    rows = []
    for i in range(n):
        idx = sorted(RNG.sample(range(dims), RNG.randint(0, 12)))
        rows.append((float(i % 3 == 0), bytearray(np.array(idx, "<u4").tobytes())))
    return rows, spark.createDataFrame(rows, "y double, idx binary").repartition(5)


def dense(rows, dims=40):
    x = np.zeros((len(rows), dims))
    for i, (_, blob) in enumerate(rows):
        x[i, np.frombuffer(bytes(blob), "<u4")] = 1
    return x, np.array([y for y, _ in rows])


def brute_ratios(x, y, alpha=2.0, errors=2.0):
    p, q = x[y == 1].sum(0), x[y == 0].sum(0)
    share = p.sum() / (p.sum() + q.sum())
    out = []
    for a, b in zip(p + alpha * share, q + alpha * (1 - share), strict=True):
        ratio = math.log((a / (p + alpha * share).sum()) / (b / (q + alpha * (1 - share)).sum()))
        error = math.sqrt(1 / a + 1 / b)
        out.append(math.copysign(max(abs(ratio) - errors * error, 0), ratio))
    return np.array(out)


def brute_fit(x, y, scale, rounds, l2, step=0.1):
    z = x * scale
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        off = 1 / (1 + np.exp(-(z @ w + b))) - y
        g = np.append(z.T @ off / len(y) + l2 * w, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = step * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w * scale, b


def test_ratios_and_weights_are_the_dense_ones(spark):
    rows, frame = sample(spark)
    x, y = dense(rows)
    packs = linear.packed(frame, 3)
    ratios = linear.log_count_ratios(packs, 40, errors=0.3)
    assert np.allclose(ratios, brute_ratios(x, y, errors=0.3), atol=1e-5) and (ratios == 0).any() and (ratios != 0).any()
    for scale in (None, ratios):
        weights, bias = linear.fit(packs, 40, scale, rounds=12, l2=1e-2)
        want = brute_fit(x, y, np.ones(40) if scale is None else scale, 12, 1e-2)
        assert np.allclose(weights, want[0], atol=1e-3) and math.isclose(bias, want[1], abs_tol=1e-3)


def test_nothing_to_fit(spark):
    packs = linear.packed(sample(spark)[1].where("false"))
    assert not linear.log_count_ratios(packs, 8).any() and linear.fit(packs, 8)[1] == 0


def test_toxic_scores_are_the_dense_models(spark):
    """Every step from texts to scores, with n-grams counted by a plain loop."""
    rows = labelled_texts(120, "vile scum idiot", 4)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(frame.drop("toxic"), toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic"))).collect()}
    grams = toxicity.Grams()
    x = np.zeros((len(rows), toxicity.DIMS), np.float32)
    for i, (_, t, _) in enumerate(rows):
        x[i, grams(t)] = 1
    y = np.array([r[2] for r in rows])
    used = np.flatnonzero(x.any(0))
    ratios = np.zeros(toxicity.DIMS)
    p, q = x[y == 1].sum(0), x[y == 0].sum(0)
    ratios[:] = linear.shrunk_ratios(p, q, 2.0, 2.0)
    w, b = brute_fit(x[:, used].astype(float), y, ratios[used], 30, 1e-3)
    want = 1 / (1 + np.exp(-(x[:, used] @ w + b)))
    assert max(abs(got[i] - want[i]) for i in range(len(rows))) < 1e-3


def test_grams_are_those_of_the_text():
    def plain(t, sizes=(3, 4, 5)):
        s = f" {' '.join(t.lower().split())} "
        return {(n, s[i : i + n]) for n in sizes for i in range(len(s) - n + 1)}

    a, b = toxicity.Grams(), toxicity.Grams()
    for t in ("Abc  d", "", "x", "aaa" * 50, "größe 𝄞"):
        assert len(a(t)) <= len(plain(t)) and (len(plain(t)) < 4 or len(a(t)) >= 0.9 * len(plain(t)))
        assert (a(t.title().lower()) == b(t.lower())).all()


def brute_em(votes, rounds=50, smooth=1.0):
    """Posterior of good for each row; votes: -1, 0 (abstains) or 1 for each voter."""
    n = len(votes[0])
    given = [[[0.4, 0.4, 0.2]] * n, [[0.05, 0.45, 0.5]] * n]
    prior = 0.8

    def good(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(given[1][j][x + 1]) - math.log(given[0][j][x + 1]) for j, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        post = [good(v) for v in votes]
        new = [[[smooth] * 3 for _ in range(n)] for _ in range(2)]
        for v, p in zip(votes, post, strict=True):
            for j, x in enumerate(v):
                new[0][j][x + 1] += 1 - p
                new[1][j][x + 1] += p
        given = [[[y / sum(x) for y in x] for x in c] for c in new]
        prior = (sum(post) + 1) / (len(votes) + 2)
    return [good(v) for v in votes]


def brute_votes(m):
    n = m["n_words"]
    bad = lambda c: -1 if c else 0
    faultless = 20 * m["n_runs"] <= n and 50 * m["n_symbols"] <= n and 4 * m["n_upper"] <= n and 10 * m["n_stutters"] <= n
    ends = -1 if m["n_lines"] >= 3 and 10 * m["n_stops"] < 3 * m["n_lines"] else 1 if 10 * m["n_stops"] > 7 * m["n_lines"] else 0
    length = -1 if 10 * m["word_chars"] < 25 * n or m["word_chars"] > 12 * n else 1 if 3 * n < m["word_chars"] < 9 * n else 0
    return (
        bad(10 * m["n_symbols"] > n), bad(50 * m["n_symbols"] > m["word_chars"]), bad(10 * m["n_runs"] > n), bad(2 * m["n_upper"] > n), bad(10 * m["n_runs"] > n and 2 * m["n_upper"] > n),
        bad(10 * m["n_repeat_words"] > 3 * n), bad(5 * m["n_stutters"] > n), bad(n >= 20 and m["n_distinct"] ** 2 < 5 * n), bad(m["n_lines"] >= 4 and 10 * m["n_dup_lines"] > 3 * m["n_lines"]), ends, length, int(faultless),
    )


def mixed_texts(spark, n=300):
    kinds = (lambda: text(80) + ".", lambda: " ".join(w.upper() + "!! $$$" for w in text(60).split()), lambda: "same line\n" * 30, lambda: text(120) + "\n" + text(30) + ".")
    rows = [(i, kinds[i % 7 % 4]()) for i in range(n)] + [(None, text(70)), (1000, None), (1001, ""), (5, text(60)), (5, text(60))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_kept_is_the_plain_models_verdict(spark):
    rows, frame = mixed_texts(spark)
    got = quality_rules.judged(frame).collect()
    assert len(got) == len(rows)
    votes = [brute_votes(r.asDict()) for r in got]
    worded = [v for v, r in zip(votes, got, strict=True) if r.n_words]
    by = dict(zip(worded, brute_em(worded), strict=True))
    for v, r in zip(votes, got, strict=True):
        if r.n_words:
            assert math.isclose(r.posterior, by[v], abs_tol=1e-6)
            assert r.kept == (not r.base_failed and by[v] >= 0.5)
        else:
            assert r.base_failed and not r.kept
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_quality_scores_are_the_dense_models(spark):
    rows, frame = mixed_texts(spark, 120)
    rows = [r for r in rows if r[0] is not None and r[0] != 5] + [(5, "only one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model, posterior = quality_classifier.fit(frame)
    soft = {r.key: r.posterior for r in posterior.collect()}
    shapes = quality_classifier.Shapes()
    x = np.zeros((len(rows), quality_classifier.DIMS))
    for i, (_, t) in enumerate(rows):
        x[i, shapes(t)] = 1
    y = np.array([soft[k] for k, _ in rows])
    used = np.flatnonzero(x.any(0))
    w, b = brute_fit(x[:, used], y, np.ones(len(used)), 40, 1e-2)
    got = {r.doc_id: r.score for r in quality_classifier.score(frame, model).collect()}
    want = 1 / (1 + np.exp(-(x[:, used] @ w + b)))
    assert max(abs(got[k] - s) for (k, _), s in zip(rows, want, strict=True)) < 2e-3


@pytest.mark.parametrize("n", [0, 1])
def test_votes_without_rows(spark, n):
    frame = spark.createDataFrame([(1, None)] * n, "a int, b int")
    model = weak.fit_votes(frame, ["a", "b"])
    assert 0 < model.prior < 1 and frame.select(weak.log_odds(model)).count() == n


"""LambdaRank against gradients written out, and on labels that no linear ranker can order."""

import math

import numpy as np
import pytest

from larkspur.operators import boosting


def test_lambdas_against_pairs():
    score, y = np.array([0.3, 1.0, -0.2, 0.5]), np.array([1, 0, 1, 0])
    rank = [2, 0, 3, 1]
    disc = [1 / math.log2(2 + r) for r in rank]
    best = 1 + 1 / math.log2(3)
    g, h = [0.0] * 4, [0.0] * 4
    for i in (0, 2):
        for j in (1, 3):
            gap = score[i] - score[j]
            delta = abs(disc[i] - disc[j]) / best / (0.01 + abs(gap))
            p = 1 / (1 + math.exp(gap))
            g[i] -= delta * p
            g[j] += delta * p
            h[i] += delta * p * (1 - p)
            h[j] += delta * p * (1 - p)
    total = sum(map(abs, g))
    got = boosting.lambdas(score, y)
    assert list(got[0]) == pytest.approx([x * math.log2(1 + total) / total for x in g]) and list(got[1]) == pytest.approx([x * math.log2(1 + total) / total for x in h])
    assert not boosting.lambdas(score, np.zeros(4))[0].any()


def test_trees_order_what_a_line_cannot(spark):
    """Relevant rows lie in the middle of f; g is noise with gaps; the fold left out is ranked right, reruns agree, and missing values pass."""
    rng = np.random.default_rng(5)
    rows = [(q, d, int(abs(f) < 0.3), f, None if d % 5 == 0 else float(rng.normal()), q % 2) for q in range(24) for d, f in enumerate(rng.uniform(-1, 1, 60).tolist())]
    x = spark.createDataFrame(rows, "q long, doc long, y int, f double, g double, fold long").repartition(5)
    specs = [boosting.Spec((0, 1), k, 2, 0) for k in range(2)]
    stored = boosting.fitted(x, "q", "y", ["f", "g"], specs, rounds=30)
    models, again = boosting.read(stored), boosting.read(boosting.fitted(x.repartition(2), "q", "y", ["f", "g"], specs, rounds=30))
    assert sorted(models) == [0, 1] and all((models[m][c] == again[m][c]).all() for m in models for c in models[m])
    got = {(r.q, r.doc): r.score for r in boosting.scored(x, ["f", "g"], models, {0: [0], 1: [1]}, 2).collect()}
    hits = []
    for q in range(24):
        mine = [(got[r[0], r[1]], r[2]) for r in rows if r[0] == q]
        n = sum(y for _, y in mine)
        hits.append(sum(y for _, y in sorted(mine, reverse=True)[:n]) / n)
    assert np.mean(hits) > 0.9
    assert boosting.importances(models[0], ["f", "g"])[0][1] > 0.8
    leaves = np.diff(np.append(models[0]["roots"], len(models[0]["feature"])))
    assert len(leaves) == 30 and (leaves <= 2 * boosting.LEAVES - 1).all()


def test_no_relevant_rows(spark):
    x = spark.createDataFrame([(1, 1, 0, 0.5, 0), (1, 2, 0, 0.1, 0)], "q long, doc long, y int, f double, fold long")
    models = boosting.read(boosting.fitted(x, "q", "y", ["f"], [boosting.Spec((0,), -1, 1, 0)]))
    assert [r.score for r in boosting.scored(x, ["f"], models, {0: [0]}, 1).collect()] == [0.0, 0.0]

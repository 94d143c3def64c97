"""LambdaRank: boosted regression trees on the gradients of pairs within a query, weighted by the change of NDCG.

Features are cut into at most ``BINS`` intervals by quantiles over all rows, missing values apart below them, and a query is one row of small arrays. Each model (a set
of features, a fold left out, a seed) is fitted in a task of its own, which holds its training rows at four bytes a feature: their number is that of the
queries times their candidates, so it grows with the queries asked and not with the corpus. Trees grow leaf by leaf from histograms, the smaller child's counted and the other's by
subtraction. Models are rows of arrays, so they can be stored; a prediction sums the leaves' values.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Those of the reference's ranker.
ROUNDS, LEAVES, RATE, LEAST, SHARE, TRUNCATION, BINS = 400, 63, 0.05, 50, 0.8, 60, 64
LEAST_HESSIAN = 1e-3
MODEL = "model int, roots array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>"


@dataclass(frozen=True)
class Spec:
    """One model: the places of its features, the fold it doesn't see (-1: it sees all) and its seed."""

    features: tuple[int, ...]
    fold: int
    folds: int
    seed: int


def lambdas(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of one query's rows; ties of score go by place."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    if not len(pos) or not len(neg):
        return g, h
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(-score, kind="stable")] = np.arange(len(y))
    discount = 1 / np.log2(2.0 + rank)
    best = (1 / np.log2(2.0 + np.arange(min(len(pos), TRUNCATION)))).sum()
    gap = score[pos][:, None] - score[neg]
    delta = np.abs(discount[pos][:, None] - discount[neg]) / best * ((rank[pos][:, None] < TRUNCATION) | (rank[neg] < TRUNCATION))
    if score.max() != score.min():
        delta /= 0.01 + np.abs(gap)
    p = 1 / (1 + np.exp(np.clip(gap, -50, 50)))
    pull, curve = delta * p, delta * p * (1 - p)
    g[pos], g[neg] = -pull.sum(1), pull.sum(0)
    h[pos], h[neg] = curve.sum(1), curve.sum(0)
    total = 2 * pull.sum()
    norm = np.log2(1 + total) / total if total > 0 else 1.0
    return g * norm, h * norm


def _histogram(codes, rows, columns, g, h, size) -> np.ndarray:
    c = codes[rows][:, columns].ravel()
    n = len(columns)
    return np.stack([np.bincount(c, np.repeat(g[rows], n), size), np.bincount(c, np.repeat(h[rows], n), size), np.bincount(c, minlength=size)])


def _split(hist: np.ndarray, columns: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of the best split; gain 0 if there is none."""
    x = hist.reshape(3, -1, BINS + 1)[:, columns]
    left = np.cumsum(x, 2)[:, :, :-1]
    total = x.sum(2)[:, :, None]
    right = total - left
    ok = (left[2] >= LEAST) & (right[2] >= LEAST) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], 0.0)
    at = int(np.argmax(gain))
    return float(gain.ravel()[at]), int(columns[at // BINS]), at % BINS


def grow(codes: np.ndarray, rows: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[list]:
    """A tree's nodes [feature, last bin on the left, left, right, value, gain]; a leaf has feature -1."""
    size, nodes, order = codes.shape[1] * (BINS + 1), [[-1, 0, -1, -1, 0.0, 0.0]], []
    value = lambda r: -RATE * g[r].sum() / max(h[r].sum(), 1e-12)
    hist = _histogram(codes, rows, columns, g, h, size)
    gain, f, b = _split(hist, columns)
    nodes[0][4] = value(rows)
    heapq.heappush(order, (-gain, 0, f, b, rows, hist))
    leaves = 1
    while order and leaves < LEAVES:
        less, node, f, b, rows, hist = heapq.heappop(order)
        if -less <= 1e-12:
            break
        goes = codes[rows, f] - f * (BINS + 1) <= b
        parts = rows[goes], rows[~goes]
        few = int(len(parts[0]) > len(parts[1]))
        counted = _histogram(codes, parts[few], columns, g, h, size)
        hists = (counted, hist - counted) if few == 0 else (hist - counted, counted)
        nodes[node][:4], nodes[node][5] = [f, b, len(nodes), len(nodes) + 1], -less
        for part, own in zip(parts, hists):
            nodes.append([-1, 0, -1, -1, value(part), 0.0])
            gain, f2, b2 = _split(own, columns)
            heapq.heappush(order, (-gain, len(nodes) - 1, f2, b2, part, own))
        leaves += 1
    return nodes


def _walk(tree: list[np.ndarray], codes_le, n: int) -> np.ndarray:
    """Each row's leaf; codes_le(rows, features, nodes) says whether a row goes left."""
    feature, left, right = tree
    at = np.zeros(n, np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        node = at[going]
        at[going] = np.where(codes_le(going, feature[node], node), left[node], right[node])
        going = going[feature[at[going]] >= 0]
    return at


def fit(bins: np.ndarray, y: np.ndarray, starts: np.ndarray, columns: np.ndarray, seed: int, rounds: int) -> list[list[list]]:
    """Trees from rows of bins, grouped by query (starts: each query's first row, and the end); only queries with a relevant row are fitted."""
    rng = np.random.default_rng(seed)
    codes = bins.astype(np.int32) + np.arange(bins.shape[1], dtype=np.int32) * (BINS + 1)
    score, trees = np.zeros(len(y)), []
    groups = [(a, b) for a, b in zip(starts[:-1], starts[1:]) if 0 < y[a:b].sum() < b - a]
    if not groups:
        return []
    for _ in range(rounds):
        g, h = np.zeros(len(y)), np.zeros(len(y))
        for a, b in groups:
            g[a:b], h[a:b] = lambdas(score[a:b], y[a:b])
        rows = np.concatenate([np.arange(a, b) for a, b in groups])
        rows = rows[rng.random(len(rows)) < SHARE]
        some = np.sort(rng.permutation(columns)[: max(1, round(SHARE * len(columns)))])
        nodes = grow(codes, rows, some, g, h)
        trees.append(nodes)
        feature, last, left, right, value = (np.array([n[i] for n in nodes]) for i in range(5))
        score += value[_walk([feature, left, right], lambda r, f, node: bins[r, f] <= last[node], len(y))]
    return trees


def cuts(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Each feature's cut points, distinct and rising: a value's bin is 1 and the number of cuts below it, 0 if missing."""
    shares = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    x = rows.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10000).alias(f) for f in features)).first()
    return [np.unique(np.array(x[f] or [], np.float64)) for f in features]


def binned(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(at, values, "left")).astype(np.uint8)


def fitted(rows: DataFrame, group: str, label: str, features: list[str], specs: list[Spec], rounds: int | None = None) -> DataFrame:
    """The models of ``specs``, one row each (``MODEL``). rows: group, doc, fold, label and the features."""
    at, rounds = cuts(rows, features), ROUNDS if rounds is None else rounds
    x = rows.select(F.col(group).cast("long").alias("q"), "fold", F.struct("doc", F.col(label).cast("int").alias("y"), *(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features))).alias("r"))
    x = x.groupBy("q", "fold").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    x = x.select("q", "fold", "rows.y", *(f"rows.f{i}" for i in range(len(features))))
    seen = F.array(*(F.when(F.lit(s.fold < 0) | (F.pmod("fold", F.lit(max(s.folds, 1))) != s.fold), F.lit(m)) for m, s in enumerate(specs)))
    x = x.withColumn("model", F.explode(F.array_compact(seen)))

    def one(key, table):
        spec = specs[key[0].as_py()]
        table = table.sort_by("q")
        lens = np.array([len(v) for v in table.column("y").to_pylist()], np.int64)
        flat = lambda c: table.column(c).combine_chunks().flatten()
        y = flat("y").to_numpy(zero_copy_only=False)
        bins = np.stack([binned(flat(f"f{i}").cast(pa.float64()).to_numpy(zero_copy_only=False), at[i]) for i in range(len(features))], 1)
        trees = fit(bins, y, np.concatenate([[0], np.cumsum(lens)]), np.array(spec.features), spec.seed, rounds)
        out: dict[str, list] = {c: [] for c in ("roots", "feature", "threshold", "left", "right", "value", "gain")}
        for nodes in trees:
            base = len(out["feature"])
            out["roots"].append(base)
            for f, b, left, right, value, gain in nodes:
                edge = np.inf if f < 0 or b > len(at[f]) else at[f][b - 1] if b else -np.inf
                for c, v in zip(("feature", "threshold", "left", "right", "value", "gain"), (f, edge, left + base, right + base, value, gain)):
                    out[c].append(v)
        kinds = {"roots": pa.int32(), "feature": pa.int32(), "left": pa.int32(), "right": pa.int32()}
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([v], pa.list_(kinds.get(c, pa.float64()))) for c, v in out.items()})

    return x.repartitionByRange(max(1, len(specs)), "model").groupBy("model").applyInArrow(one, MODEL)


def read(models: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """The stored models by number; the driver holds their trees."""
    return {r.model: {c: np.array(r[c]) for c in ("roots", "feature", "threshold", "left", "right", "value", "gain")} for r in models.collect()}


def leaf_sums(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The model's score of rows of features; a missing value is below all others."""
    x, out = np.where(np.isnan(x), -np.inf, x), np.zeros(len(x))
    feature, left, right, edge, value = (model[c] for c in ("feature", "left", "right", "threshold", "value"))
    for root in model["roots"]:
        at = np.full(len(x), root, np.int64)
        going = np.flatnonzero(feature[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = np.where(x[going, feature[node]] <= edge[node], left[node], right[node])
            going = going[feature[at[going]] >= 0]
        out += value[at]
    return out


def scored(rows: DataFrame, features: list[str], models: dict[int, dict], of: dict[int, list[int]], folds: int) -> DataFrame:
    """rows with score: the mean of the models that ``of`` names for the row's fold."""

    def score(batches):
        for batch in batches:
            x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1) if batch.num_rows else np.zeros((0, len(features)))
            fold, out = batch.column("fold").to_numpy(zero_copy_only=False) % folds, np.zeros(batch.num_rows)
            for k, names in of.items():
                at = np.flatnonzero(fold == k)
                out[at] = np.mean([leaf_sums(models[m], x[at]) for m in names], 0) if len(at) else 0.0
            yield batch.append_column("score", pa.array(out))

    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def importances(model: dict[str, np.ndarray], features: list[str]) -> list[tuple[str, float]]:
    """Each feature's share of the splits' gains."""
    total = [float(model["gain"][model["feature"] == i].sum()) for i in range(len(features))]
    return [(f, g / max(sum(total), 1e-300)) for f, g in zip(features, total)]

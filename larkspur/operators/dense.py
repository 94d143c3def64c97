"""Exact inner products of a stated query set against all vectors, block by block.

Queries and corpus meet in cells of bounded size (a block of each), where matrix products of at most ``SCORES`` scores score them, a few queries at a time, and only each query's best
rows and its sums leave a cell; so no table of all pairs exists, and a task's memory doesn't grow with the tables. Blocks are dealt by a hash, and lists are merged by a
window per query. Scores are rounded to ``DIGITS`` before they are ranked, and ties go to the smaller row.

Rows whose id or vector is null take no part; an empty side gives no rows. All vectors must have one length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CORPUS_BLOCK, SCORES, DIGITS = 2048, 16384, 1 << 20, 9
SCHEMA = "list string, q long, doc long, score double, total double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller doc."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((docs[at], -scores[at]))][:k]


def _rows(parts: list[tuple]) -> pa.Table:
    """One table of (list, q, doc, score, total), each part a name and four arrays."""
    q, doc, score, total = (np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i in range(1, 5))
    names = pa.array([p[0] for p in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
    return pa.table({"list": names, "q": q.astype(np.int64), "doc": doc.astype(np.int64), "score": score.astype(np.float64), "total": total.astype(np.float64)})


def _places(right: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of a block of rows: the numbers of their places, each row's, and its share."""
    places, of = np.unique(np.array(right.column("iloc").to_pylist(), object).astype(str), return_inverse=True)
    return {x: i for i, x in enumerate(places.tolist())}, of, np.asarray(right.column("base").to_numpy())


def _log_prior(left: pa.Table, at: dict, of: np.ndarray, base: np.ndarray) -> np.ndarray:
    """ln(p + 1e-7) of every query's location and every row's."""
    from larkspur.operators.retrieval import ALPHA, EPS, OTHER, SAME

    seen, rows = np.zeros((left.num_rows, len(at))), []
    for i, pairs in enumerate(left.column("cnts").to_pylist()):
        for pair in pairs or []:
            if pair["iloc"] in at:
                seen[i, at[pair["iloc"]]] = pair["cnt"]
    for i, (sloc, n) in enumerate(zip(left.column("sloc").to_pylist(), left.column("n_s").to_pylist())):
        rows.append((seen[i][of] + ALPHA * base) / (n + ALPHA) if n is not None else np.where(of == at.get(sloc, -1), SAME, OTHER * base))
    return np.log(np.stack(rows) + EPS)


def _cells(queries: DataFrame, corpus: DataFrame, score, moments: bool, known=lambda right: None) -> DataFrame:
    nq, n = queries.count(), corpus.count()
    cols, parts = max(1, math.ceil(nq / QUERY_BLOCK)), max(1, math.ceil(n / CORPUS_BLOCK))
    parts = max(parts, min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1024)))

    def cell(key, left, right):
        made, docs = [], right.column("doc").to_numpy()
        n = right.num_rows and left.num_rows
        dv, of = (_matrix(right.column("dv")).T, known(right)) if n else (None, None)
        step = max(1, SCORES // max(1, right.num_rows))
        for start in range(0, left.num_rows if n else 0, step):
            few, rows = left.slice(start, step), []
            q = few.column("q").to_numpy()
            d = np.round(_matrix(few.column("qv")) @ dv, DIGITS)
            own = few.column("own").to_numpy()[:, None] == docs
            if moments:
                x = np.where(own, 0.0, d)
                rows.append(("", q, (~own).sum(1), x.sum(1), (x * x).sum(1)))
            for name, k, s in score(few, of, d):
                s = np.where(own, -np.inf, s)
                for i in range(len(q)):
                    got = _best(s[i], docs, k)
                    got = got[np.isfinite(s[i][got])]
                    rows.append((name, np.full(len(got), q[i]), docs[got], s[i][got], d[i][got]))
            made.append(_rows(rows))
        return pa.concat_tables(made or [_rows([])])

    left = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(cols)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = corpus.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(cell, SCHEMA)


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(q, doc, score, rank) of the k best rows, and (q, n, pop, samp): rows scored and the scores' deviations over the corpus.

    queries: (q, qv, own): own is the row a query must not meet (-1: none); corpus: (doc, dv)."""
    x = _cells(queries, corpus, lambda left, of, d: [("top", k, d)], True)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    top = x.filter("list = 'top'").select("q", "doc", "score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    m = x.filter("list = ''").groupBy("q").agg(F.sum("doc").alias("n"), F.sum("score").alias("s"), F.sum("total").alias("t"))
    spread = F.greatest(F.col("t") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return top, m.select("q", "n", F.sqrt(spread / F.col("n")).alias("pop"), F.sqrt(spread / F.greatest(F.col("n") - 1, F.lit(1))).alias("samp"))


def located(queries: DataFrame, corpus: DataFrame, lists: list[tuple[str, int, str, float, float]]) -> DataFrame:
    """(list, q, doc, score, rank) of scores that add the location prior: for each (name, k, scale, a, b) the k best by
    a * scale * d + b * ln(p + 1e-7).

    queries: (q, qv, own, sloc, n_s, cnts, and the named scale columns): n_s the location's log rows (null: none), cnts its
    (iloc, rows); corpus: (doc, dv, iloc, base). p is as in ``retrieval.location_prior``, from these parts: no table of location pairs."""

    def score(left, of, d):
        lp = _log_prior(left, *of)
        return [(name, k, np.round(a * (d * left.column(scale).to_numpy()[:, None]) + b * lp, DIGITS)) for name, k, scale, a, b in lists]

    x = _cells(queries, corpus, score, False, _places)
    w = Window.partitionBy("list", "q").orderBy(F.desc("score"), "doc")
    sizes = F.create_map(*(F.lit(v) for name, k, *_ in lists for v in (name, k)))
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= sizes[F.col("list")]).select("list", "q", "doc", "score", "rank")

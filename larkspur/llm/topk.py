"""Exact top-k inner products, term at a time.

Vectors become sparse integer rows. A cell holds one block of candidates as postings (for each
dimension the candidates with a weight there) and one block of queries; each query dimension
scatters its weighted postings into a dense score array, a partition selection keeps the k best, and
the cells' lists are merged for each query. Queries and candidates are dealt to cells in blocks of
fixed size, so a cell's memory is bounded whatever the table's size.

Vectors that are null or hold null or non-finite components take no part; a shorter vector has no
weight in the dimensions it lacks. Every row is numbered: a repeated query row gets a list of its own, in which the other
rows with its id are candidates like any other. Ties go to the smaller id, a null id last; rows with a null id are candidates and no
queries. An empty table gives no rows; only the id and the vector are read. Weights must stay below 2^31 and scores below 2^62.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import numbered

NO_ID = (1 << 63) - 1
QUERY_BLOCK, CANDIDATE_BLOCK, SCORES = 4096, 1 << 15, 1 << 21


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 64) -> DataFrame:
    """(id, weights): floor(scale * x) of every usable vector."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.filter(e.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("long").alias("id"), whole.alias("weights"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order (NO_ID for null), the rows' numbers, and their weights, zero where a vector is shorter."""
    ids, rows_ = table.column("id").fill_null(NO_ID).to_numpy(), table.column("row").to_numpy()
    order = np.lexsort((rows_, ids))
    lists = table.column("weights").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    dense = np.zeros((len(ids), int(n.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(ids)), n)
    dense[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return ids[order], rows_[order], dense[order]


def accumulate(queries: np.ndarray, candidates: np.ndarray, kind=np.int64) -> np.ndarray:
    """Scores of every query and candidate: each dimension's postings, weighted, added in."""
    scores = np.zeros((len(queries), len(candidates)), kind)
    for t in range(min(queries.shape[1], candidates.shape[1])):
        rows, docs = np.flatnonzero(queries[:, t]), np.flatnonzero(candidates[:, t])
        if not len(rows) or not len(docs):
            continue
        weights = candidates[docs, t].astype(kind)
        if 2 * len(docs) >= len(candidates):  # postings that hold most candidates are added as a run
            weights, docs = candidates[:, t].astype(kind), slice(None)
        for r in rows:
            scores[r, docs] += kind(queries[r, t]) * weights
    return scores


def best(scores: np.ndarray, own: int | None, k: int) -> np.ndarray:
    """Places of the k highest scores, place ``own`` left out, ties to the first."""
    k = min(k, len(scores) - (own is not None))
    if k <= 0:
        return np.zeros(0, np.int64)
    if own is not None:
        scores[own] = np.iinfo(scores.dtype).min
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    ties = np.flatnonzero(scores == least)
    if own is not None:
        ties = ties[ties != own]
    got = np.concatenate([above, ties[: k - len(above)]])
    return got[np.lexsort((got, -scores[got]))]


def top_k(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, id, score) over ``rows`` (id, weights); is_query: a condition on the id."""
    rows = numbered(rows, "row", "vectors")
    size = F.array_max(F.transform("weights", lambda w: F.abs(w)))
    n, nq, top = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(size), F.lit(0))).first()
    kind = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if top < 1 << bits)
    rows = rows.withColumn("weights", F.col("weights").cast(f"array<{kind}>"))  # cells are copies: as narrow as they can be
    cols, parts = max(1, math.ceil(nq / QUERY_BLOCK)), max(1, math.ceil(n / CANDIDATE_BLOCK))
    parts = max(parts, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1024)) if n else 1)

    def score(key, left, right):
        found = [[], [], [], []]
        if left.num_rows and right.num_rows:
            q_ids, q_rows, q = _matrix(left)
            c_ids, c_rows, c = _matrix(right)
            place = {r: i for i, r in enumerate(c_rows.tolist())}
            kind = np.int32 if int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 1 << 31 else np.int64
            step = max(1, SCORES // len(c_ids))
            for at in range(0, len(q_ids), step):
                scores = accumulate(q[at : at + step], c, kind)
                for own, row, line in zip(q_ids[at : at + step], q_rows[at : at + step].tolist(), scores):
                    got = best(line, place.get(row), k)
                    for x, v in zip(found, (np.full(len(got), row), np.full(len(got), own), c_ids[got], line[got].astype(np.int64))):
                        x.append(v)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(("row", "query_id", "id", "score"), found)})

    cand = rows.withColumn("p", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    asks = rows.filter(is_query).withColumn("b", F.pmod(F.xxhash64("row"), F.lit(cols)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    lists = asks.groupBy("p", "b").cogroup(cand.groupBy("p", "b")).applyInArrow(score, "row long, query_id long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("id"), "score")

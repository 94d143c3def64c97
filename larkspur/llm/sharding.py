"""Sharding by histogram sort: shards of near equal bytes, cut at exact splitters of one sort key.

The key is (hash of the text, doc_id, the row's number in the written table), so equal texts stand together and no two rows
have one key. Each round every task counts the bytes below a few probe keys and the driver narrows each splitter to the histogram
cell that holds its target, until every splitter meets its tolerance; only then are the documents exchanged, once.
A round returns a row for each probe, never a document. A group of copies larger than a shard is cut by doc_id, and equal
rows by number, so no shard outgrows the others. The exchange has a part for every ``PART_BYTES``, inside shards at
splitters with a tolerance, so the driver holds some numbers for each part.

Null texts have no bytes and a group of their own; a null doc_id sorts first; repeated rows are kept; a text longer than a
shard leaves shards empty; an empty table gives no rows. Columns named as the result's own are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import numbered, partitions, release, written

PROBES = 64
PART_BYTES = 1 << 26
_LOW = -(1 << 63)


def _join(h: int, i: int, u: int) -> int:
    return (h - _LOW) << 128 | (i - _LOW) << 64 | u


def _part(key: int) -> tuple[int, int, int]:
    return min((key >> 128) + _LOW, (1 << 63) - 1), (key >> 64 & ((1 << 64) - 1)) + _LOW, min(key & ((1 << 64) - 1), (1 << 63) - 1)


def _places(columns: list[np.ndarray], probes: list[tuple], lo: int = 0, hi: int | None = None) -> list[int]:
    """For each of the ascending probes, how many of the sorted rows are below it; rows lo to hi are equal in the columns before."""
    column = columns[0][lo:hi]
    first = np.array([p[0] for p in probes], np.int64)
    below, upto = lo + np.searchsorted(column, first, "left"), lo + np.searchsorted(column, first, "right")
    if len(columns) == 1:
        return below.tolist()
    return [_places(columns[1:], [p[1:]], a, b)[0] if b > a else a for a, b, p in zip(below.tolist(), upto.tolist(), probes)]


@dataclass
class Splitter:
    """Rows with keys from ``key`` on belong above it; rows and bytes are those below."""

    key: int
    rows: int
    bytes: int


def histogram(keys: DataFrame, probes: list[int]) -> list[tuple]:
    """(cell, rows, bytes, lowest key, highest key) of the non-empty cells between the probes."""
    pairs = [_part(p) for p in probes]

    def count(batches):
        got: dict[int, list] = {}
        for batch in batches:
            h, i, u, s = (batch.column(c).to_numpy() for c in range(4))
            order = np.lexsort((u, i, h))
            h, i, u, s = h[order], i[order], u[order], np.concatenate([[0], np.cumsum(s[order])])
            cuts = np.array([0, *_places([h, i, u], pairs), len(h)])
            for c in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[c], cuts[c + 1]
                low, high = (tuple(int(x[k]) for x in (h, i, u)) for k in (a, b - 1))
                x = got.setdefault(int(c), [0, 0, low, high])
                got[int(c)] = [x[0] + int(b - a), x[1] + int(s[b] - s[a]), min(x[2], low), max(x[3], high)]
        cells = list(got.items())
        yield pa.RecordBatch.from_pydict({"cell": pa.array([c for c, _ in cells], pa.int64()), "n": pa.array([x[0] for _, x in cells], pa.int64()), "b": pa.array([x[1] for _, x in cells], pa.int64())} | {name: pa.array([x[k][j] for _, x in cells], pa.int64()) for name, k, j in (("lh", 2, 0), ("li", 2, 1), ("lu", 2, 2), ("hh", 3, 0), ("hi", 3, 1), ("hu", 3, 2))})

    part = keys.mapInArrow(count, "cell long, n long, b long, lh long, li long, lu long, hh long, hi long, hu long")
    rows = part.groupBy("cell").agg(F.sum("n"), F.sum("b"), F.min(F.struct("lh", "li", "lu")), F.max(F.struct("hh", "hi", "hu"))).collect()  # a row for each probe at most
    return sorted((r[0], r[1], r[2], _join(*r[3]), _join(*r[4])) for r in rows)


def find_splitters(keys: DataFrame, targets: list[tuple[int, int]], probes: int = PROBES) -> list[Splitter]:
    """keys: (h, i, u, size), none null. A splitter for each (bytes below, tolerance): the lowest key with at
    least so many bytes below, or any key whose bytes below exceed that by no more than the tolerance."""
    done: dict[tuple[int, int], Splitter] = {}
    cuts: list[int] = []
    open_ = dict.fromkeys(targets)
    while open_:
        cells = histogram(keys, cuts)
        rows = total = 0
        spans = []
        for _, n, b, low, high in cells:
            spans.append((rows, total, n, b, low, high))
            rows, total = rows + n, total + b
        ends = np.array([s[1] + s[3] for s in spans])
        wanted: dict[int, list] = {}
        for t in list(open_):
            k = int(np.searchsorted(ends, t[0], "left"))
            if k == len(spans):
                done[t] = Splitter(1 << 193, rows, total)
                del open_[t]
                continue
            r, below, n, b, low, high = spans[k]
            if t[0] <= below:  # only for a target of 0 bytes
                done[t] = Splitter(low, r, below)
            elif low == high or below + b - t[0] <= t[1]:
                done[t] = Splitter(high + 1, r + n, below + b)
            else:
                wanted.setdefault(k, []).append(t)
                continue
            del open_[t]
        cuts = []
        for k, inside in sorted(wanted.items()):  # the spans between are single cells, so all rows stay counted
            low, high = spans[k][4:]
            step = max(1, (high - low) // max(probes, 4 * len(inside)))
            cuts += [low, *range(low + step, high + 1, step), high + 1]
    return [done[t] for t in targets]


def shard(docs: DataFrame, n_shards: int, size, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (0 to n_shards - 1, bytes near equal: row r is in shard floor(bytes below r * n_shards /
    all bytes)) and slot (its place in the shard, in key order, from 0)."""
    spark = docs.sparkSession
    h = F.coalesce(F.conv(F.substring(F.md5(F.col(text).cast("string")), 1, 15), 16, 10).cast("long"), F.lit(-1))
    keyed = docs.drop("shard", "slot", "__h", "__i", "__u").withColumn("__h", h).withColumn("__i", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW))).withColumn("__size", size.cast("long"))
    keyed = numbered(keyed, "__u", "shard-rows")
    keys = written(keyed.select("__h", "__i", "__u", "__size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    parts = max(n_shards, partitions(spark), math.ceil(total / PART_BYTES))
    exact = [(-(-k * total // n_shards), 0) for k in range(1, n_shards)]
    loose = [(k * total // parts, total // (4 * parts)) for k in range(1, parts)]
    wanted = list(dict.fromkeys(x for x in exact + loose if x[0] > 0))
    found = find_splitters(keys, wanted) if total else []
    release(spark, keys)
    at = dict(zip(wanted, found))
    bounds = sorted((at[x].key, at[x].rows) for x in exact if x in at)  # where shard 1, 2, ... begin; equal for an empty one
    cuts = sorted({(s.key, s.rows) for s in found})
    edges = [_part(k) for k, _ in cuts]
    lines = []
    for p, (key, rows) in enumerate([(-1, 0), *cuts]):
        s = bisect_right([b[0] for b in bounds], key)
        lines.append((p, s, rows - (bounds[s - 1][1] if s else 0)))
    columns = [np.array([e[j] for e in edges], np.int64) for j in range(3)]

    @F.pandas_udf("long")
    def part_of(h: pd.Series, i: pd.Series, u: pd.Series) -> pd.Series:
        x = [c.to_numpy() for c in (h, i, u)]
        lo, hi = np.searchsorted(columns[0], x[0], "left"), np.searchsorted(columns[0], x[0], "right")
        out = lo.copy()
        for k in np.flatnonzero(hi > lo):  # splitters inside one group of copies
            out[k] = bisect_right(edges, (int(x[0][k]), int(x[1][k]), int(x[2][k])), int(lo[k]), int(hi[k]))
        return pd.Series(out)

    order = Window.partitionBy("__p").orderBy("__h", "__i", "__u")
    placed = keyed.withColumn("__p", part_of("__h", "__i", "__u") if edges else F.lit(0).cast("long"))
    placed = placed.repartition(parts, "__p")  # a given count isn't coalesced: parts have their size already
    numbered_ = placed.withColumn("__n", F.row_number().over(order) - 1)
    where = spark.createDataFrame(lines, "__p long, shard int, __base long")  # a row for each part
    out = numbered_.join(F.broadcast(where), "__p").withColumn("slot", F.col("__base") + F.col("__n"))
    return out.select(*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")

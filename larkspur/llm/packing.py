"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are dealt at random into groups of about ``GROUP_DOCS`` documents and ``GROUP_BYTES`` of text;
each group is packed on its own, so groups run in parallel and none grows with the corpus. The hash that deals
covers the document, its partition and how many equal ones that partition had before, so equal rows spread over all groups and a
task that runs again deals alike. A document's full sequences stand alone; its remainder is one piece, and the
remainders of a group go, longest first, into the first sequence with room, found by walking down the tree. Ties go by
doc_id (null first), then by the ids' checksum, so the order in which rows arrive decides nothing.

Null and empty texts are one end id. Repeated rows are packed each by itself. A very long text is one row of its group. An empty
table gives no pieces. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_DOCS, GROUP_BYTES = 1024, 1 << 24


class CapacityTree:
    """Room left in each bin, the larger child's room in each parent. First fit takes log2(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place size into the first bin with room; its number and the room it had."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        had = room[k]
        room[k] = had - size
        bin_ = k - self.leaves
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; ties keep their order."""
    tree, out = CapacityTree(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, had = tree.put(sizes[i])
        out[i] = bin_, capacity - had
    return out


def encoded(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, width, ids, salt): ids as little-endian binary, the end id included; salt deals equal rows apart."""

    def encode(batches):
        from pyspark import TaskContext

        from larkspur.llm.tokens import encoder

        enc, partition, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.encode(s or "") + end for s in part.column(1).to_pylist()]
                salts = []
                for doc, x in zip(part.column(0).to_pylist(), ids):
                    key = (doc, len(x), zlib.crc32(x))
                    seen[key] += 1
                    salts.append(partition << 32 | seen[key] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_tokens": pa.array([len(x) // width for x in ids], pa.int64()), "width": pa.array([width] * len(ids), pa.int32()), "ids": pa.array(ids, pa.binary()), "salt": pa.array(salts, pa.int64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, width int, ids binary, salt long")


def pack(tokens: DataFrame, groups: int, capacity: int = 1024) -> DataFrame:
    """Pieces of the documents in ``tokens`` (doc_id, n_tokens, width, ids, salt), packed in so many groups: start and length in their
    document, sequence and offset there, and their ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def place(key, table):
        base = key[0].as_py() << 32
        table = table.append_column("crc", pa.array([zlib.crc32(x.as_buffer()) for x in table.column("ids")], pa.int64()))
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "crc", "n_tokens")], null_placement="at_start")).combine_chunks()
        sizes = table.column("n_tokens").to_pylist()
        full = [n // capacity for n in sizes]
        rest = [n % capacity for n in sizes]
        rows = [i for i, n in enumerate(rest) if n]
        placed = dict(zip(rows, first_fit_decreasing([rest[i] for i in rows], capacity)))
        bins = max((b for b, _ in placed.values()), default=-1) + 1
        out = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for i, (doc, n, width, raw) in enumerate(zip(table.column("doc_id").to_pylist(), sizes, table.column("width").to_pylist(), table.column("ids"))):
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4").tobytes()
            for k in range(full[i]):
                for c, v in zip(out, (doc, k * capacity, capacity, n, base + bins, 0, ids[4 * k * capacity : 4 * (k + 1) * capacity])):
                    out[c].append(v)
                bins += 1
            if i in placed:
                b, at = placed[i]
                for c, v in zip(out, (doc, full[i] * capacity, rest[i], n, base + b, at, ids[4 * full[i] * capacity :])):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    dealt = tokens.withColumn("grp", F.pmod(F.xxhash64("doc_id", "n_tokens", "salt"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    return pack(encoded(docs, path, end_id, doc_id, text), max(1, math.ceil(n / GROUP_DOCS), math.ceil(size / GROUP_BYTES)), capacity)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

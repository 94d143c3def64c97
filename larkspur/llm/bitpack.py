"""Token ids on disk: every id in the fewest bits the vocabulary needs, with block offsets.

File (little-endian): ``MAGIC``, the payload's blocks, then the index: the documents' ids (int64), whether each is null
(uint8), where each starts (int64, one more at the end) and each block's byte offset in the payload (int64); last
uint64s: bits, documents, ids, ids in a block, blocks. A block holds ``BLOCK_IDS`` ids and starts at a byte, so any range of
ids is found by one offset and unpacked with numpy alone. Blocks go to the file as they fill, so a writer holds one block
and the index of its part.

Parts are cut by ranges of about ``PART_BYTES`` of text and written in ascending doc_id order, null first (rows with one id: by
a hash of the text, then the text, in all parts alike); a manifest has each part's place in the whole. A part is written under
another name and then renamed, so a task that runs again leaves the same file. Null texts are empty; repeated rows are
written each by itself; very long texts span blocks; an empty table gives parts without documents.
"""

from __future__ import annotations

import json
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import new_path, partitions

MAGIC = b"LKBITS01"
BLOCK_IDS = 1 << 16
PART_BYTES = 1 << 27


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in ``bits`` bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(cells.reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    cells = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = cells
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def _files(uri: str):
    """A pyarrow file system and the path in it; plain and file: paths need no pyarrow driver."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class PartWriter:
    """Packs blocks and writes them as they fill; of a part only the open block and the index are held."""

    def __init__(self, uri: str, bits: int, attempt: str):
        self.bits, self.docs, self.null, self.starts = bits, [], [], [0]
        self.offsets, self.open, self.pending = [0], [], 0
        self.files, self.path = _files(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{attempt}"
        self.stream = self.files.open_output_stream(self.temporary)
        self.stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {ids.max()} needs more than {self.bits} bits")
        self.docs.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.pending += len(ids)
        if self.pending >= BLOCK_IDS:
            self._cut(BLOCK_IDS)

    def _cut(self, least: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        at = 0
        while len(ids) - at >= max(1, least):
            block = pack_bits(ids[at : at + BLOCK_IDS], self.bits)
            self.stream.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
            at += BLOCK_IDS
        self.open, self.pending = [ids[at:].copy()], max(0, len(ids) - at)

    def close(self) -> int:
        self._cut(1)
        for values, kind in ((self.docs, "<i8"), (self.null, "u1"), (self.starts, "<i8"), (self.offsets, "<i8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(np.array([self.bits, len(self.docs), self.starts[-1], BLOCK_IDS, len(self.offsets) - 1], "<u8").tobytes())
        self.stream.close()
        self.files.move(self.temporary, self.path)
        return self.starts[-1]


class PartReader:
    """Random access to one part: ids(a, b) reads only the blocks that hold them."""

    def __init__(self, uri: str):
        files, path = _files(uri)
        self.file = files.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"not a packed part: {uri}")
        end = self.file.size() - 40
        self.file.seek(end)
        self.bits, n, self.n_ids, self.block_ids, blocks = map(int, np.frombuffer(self.file.read(40), "<u8"))
        self.file.seek(end - 8 * n - n - 8 * (n + 1) - 8 * (blocks + 1))
        self.docs = np.frombuffer(self.file.read(8 * n), "<i8")
        self.null = np.frombuffer(self.file.read(n), "u1")
        self.starts = np.frombuffer(self.file.read(8 * (n + 1)), "<i8")
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<i8")
        self.payload = len(MAGIC)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, "<u4")
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        self.file.seek(self.payload + int(self.offsets[first]))
        raw = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        got = []
        for k in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            at = int(self.offsets[k] - self.offsets[first])
            got.append(unpack_bits(raw[at : at + int(self.offsets[k + 1] - self.offsets[k])], n, self.bits))
        return np.concatenate(got)[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, path: str, end_id: int, out: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode docs with the tokenizer file at ``path`` and write them in order; the folder written."""
    spark = docs.sparkSession
    out = out or new_path(spark, "bitpack")

    def write(batches):
        from pyspark import TaskContext

        from larkspur.llm.tokens import encoder

        task = TaskContext.get()
        part, enc = task.partitionId(), encoder(path)
        uri = f"{out}/part-{part:06d}.bits"
        end, to = np.array([end_id], enc.dtype).tobytes(), PartWriter(uri, max(1, max(enc.largest, end_id).bit_length()), str(task.taskAttemptId()))
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                to.add(doc, np.frombuffer(enc.encode(s.as_py() or "") + end, enc.dtype))
        n = to.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "n_docs": [len(to.docs)], "n_ids": [n]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    by = ("doc_id", F.xxhash64("text"))
    # equal rows may lie in several parts: which of them is which doesn't matter
    ranged = rows.repartitionByRange(max(partitions(spark), math.ceil(size / PART_BYTES)), *by, F.monotonically_increasing_id()).sortWithinPartitions(*by, "text")
    parts = ranged.mapInArrow(write, "part long, path string, n_docs long, n_ids long").collect()  # a row for each partition
    before, lines = 0, []
    for r in sorted(parts, key=lambda r: r.part):
        lines.append(r.asDict() | {"start": before})
        before += r.n_ids
    files, root = _files(out)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(lines).encode())
    return out


def manifest(out: str) -> list[dict]:
    files, root = _files(out)
    with files.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    parts = [(x["path"], x["start"]) for x in manifest(out) if x["n_docs"]]

    def load(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = PartReader(uri)
                for at in range(0, len(part.docs), 1024):
                    upto = min(at + 1024, len(part.docs))
                    low = int(part.starts[at])
                    ids = part.ids(low, int(part.starts[upto]))
                    cut = part.starts[at : upto + 1] - low
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(part.docs[at:upto], pa.int64(), mask=part.null[at:upto].astype(bool)),
                        "start": pa.array(part.starts[at:upto] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(cut), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])], pa.int64()),
                    })

    rows = spark.createDataFrame(parts, "path string, start long").repartition(max(1, min(len(parts), partitions(spark))))
    return rows.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")

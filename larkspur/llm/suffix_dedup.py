"""Removal of every byte that a repeated string of 200 bytes covers, by a sparse suffix array built with a distributed merge sort.

0. Equal texts are one text with two 64-bit names; a text that several rows have is a repeat as a whole if it has 200 bytes. All
   steps below see each text once, so n equal rows cost n small rows and not n contexts of each anchor.
1. Anchors (see ``suffixes``) whose 100 bytes occur once in the corpus can't be in a repeat; hashes of the others' 100 bytes,
   counted with partial sums, leave those that may be.
2. Each task cuts the contexts of its documents' remaining anchors out of the texts, sorts them and front-codes the sorted run in
   blocks; a bounded sample of the blocks' first keys gives splitters.
3. Blocks go to the tasks of their key ranges, which merge them with a loser tree that never compares a known common prefix
   again. Keys end in a hash of their place, so that a group of equal contexts can be cut anywhere.
4. The merged order's common prefixes and the names of the other side's contexts decide each window of the range exactly.
   Windows whose equals may lie in another range (they agree with a splitter to the depth in question) go through steps 2 to 4
   again with left contexts first; the few that agree with both kinds of splitter are counted by 128-bit hashes.

So all but those few windows, and the equality of texts, are decided on bytes; these two are decided on 128 bits. The driver holds
``OVERSAMPLE`` keys of 304 bytes for every ``RANGE`` contexts.

Matches never cross documents. Null texts are empty. Repeated rows are copies of each other, so their bytes go. Texts of fewer than 200 bytes
keep all. Very long texts are cut into overlapping pieces and keep their places. Ties between equal contexts go by a hash of the place
and decide nothing. An empty table gives no rows. Columns named as the result's own are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import partitions, release, text_names, written
from larkspur.llm.suffixes import LEFT, LENGTH, RIGHT

RUN, BLOCK, RANGE, OVERSAMPLE = 100_000, 256, 50_000, 8
#: Texts whose names a task remembers, so that it sends copies once; rows of one document are dealt to so many salts.
SEEN, SALTS = 200_000, 16
FIELDS = 4  # of a context: text's number, place, least d, greatest d
BLOCK_SCHEMA = "first binary, last binary, n long, payload binary"
FOUND_SCHEMA = "kind int, rid long, lo long, hi long, h1 long, h2 long, first binary, last binary, n long, payload binary"
SPANS, BLOCKS, WINDOWS = 0, 1, 2


def _found(kind: int, count: int, **columns) -> pa.RecordBatch:
    kinds = {"rid": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "first": pa.binary(), "last": pa.binary(), "n": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(count, kind), pa.int32())} | {c: pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in kinds.items()})


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    x = docs.withColumn("__s", t)
    h1, h2 = text_names("__s")
    return x.withColumn("__h1", h1).withColumn("__h2", h2).withColumn("__t", F.col("__s").cast("binary")).drop("__s")


def _fresh(seen: set, batch: pa.RecordBatch, at: int) -> list[int]:
    """Rows of the batch whose text this task hasn't had; columns at and at + 1 name it."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for i, name in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())):
        if name not in seen:
            seen.add(name)
            out.append(i)
    return out


def repeated_grams(keyed: DataFrame) -> DataFrame:
    """Hashes of the 100-byte strings at anchors that occur twice or more. Copies that several tasks have count as well."""

    def count(batches):
        from larkspur.llm.suffixes import anchors, pieces

        seen = set()
        for batch in batches:
            texts = batch.column(2)
            for held in pieces([texts[i].as_py() or b"" for i in _fresh(seen, batch, 0)]):
                gram, n = np.unique(anchors(held)[4].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(gram), "n": pa.array(n, pa.int64())})

    part = keyed.select("__h1", "__h2", "__t").mapInArrow(count, "gram long, n long")
    return written(part.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")


def candidates(keyed: DataFrame, grams: DataFrame) -> DataFrame:
    """(h1, h2, places): for each text its anchors whose 100 bytes occur again; place, least and greatest d in one number."""

    def find(batches):
        from larkspur.llm.suffixes import anchors, pieces, whole

        seen = set()
        for batch in batches:
            new = np.array(_fresh(seen, batch, 0), np.int64)
            h1, h2, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for held in pieces([texts[i].as_py() or b"" for i in new.tolist()]):
                doc, place, low, high, gram = whole(*anchors(held))
                yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "h1": pa.array(h1[new[doc]]), "h2": pa.array(h2[new[doc]]), "place": pa.array(place << 14 | low << 7 | high)})

    rows = keyed.select("__h1", "__h2", "__t").mapInArrow(find, "gram long, h1 long, h2 long, place long")
    return written(rows.join(grams, "gram").groupBy("h1", "h2").agg(F.collect_set("place").alias("places")), "anchors")


def _tie(rid: np.ndarray, place: np.ndarray) -> np.ndarray:
    from larkspur.llm.shingles import mixed

    return mixed(mixed(rid.view(np.uint64)) + place.astype(np.uint64)).astype(">u4").view(np.uint8).reshape(-1, 4)


def _run_blocks(rows: np.ndarray, meta: np.ndarray):
    """(first, last, n, payload) of the blocks of a sorted run."""
    from larkspur.llm.suffixes import encode_block, sort_run

    order = sort_run(rows)
    for at in range(0, len(rows), BLOCK):
        some = order[at : at + BLOCK]
        part = rows[some]
        yield part[0].tobytes(), part[-1].tobytes(), len(part), encode_block(part, meta[some])


def runs(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """Front-coded blocks of sorted runs of contexts, right context first, and a row for each text's number (n, payload null) and name.
    Each text counts once; its number is this task's and stands in the table with the blocks that use it."""

    def cut(batches):
        from larkspur.llm.suffixes import contexts

        from pyspark import TaskContext

        rows, meta, size, number = [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            if size:
                r, m = np.concatenate(rows), np.concatenate(meta)
                rows.clear(), meta.clear()
                got = list(zip(*_run_blocks(r, m)))
                yield pa.RecordBatch.from_pydict({"first": pa.array(got[0], pa.binary()), "last": pa.array(got[1], pa.binary()), "n": pa.array(got[2], pa.int64()), "payload": pa.array(got[3], pa.binary()), "h1": pa.nulls(len(got[0]), pa.int64()), "h2": pa.nulls(len(got[0]), pa.int64())})

        for batch in batches:
            no = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_pydict({"first": no, "last": no, "n": pa.array(np.arange(number, number + batch.num_rows)), "payload": no, "h1": batch.column(0), "h2": batch.column(1)})
            for i in range(batch.num_rows):
                packed = np.sort(np.asarray(batch.column(2)[i].values))
                text = batch.column(3)[i].as_py()
                for at in range(0, len(packed), RUN):
                    part = packed[at : at + RUN]
                    place = part >> 14
                    m = np.stack([np.full(len(part), number), place, part >> 7 & 127, part & 127], axis=1).astype(np.int64)
                    rows.append(np.concatenate([contexts(text, place), _tie(m[:, 0], place)], axis=1))
                    meta.append(m)
                    size += len(part)
                    if size >= RUN:
                        yield from flush()
                        rows, meta, size = [], [], 0
                number += 1
        yield from flush()

    texts = keyed.groupBy(F.col("__h1").alias("h1"), F.col("__h2").alias("h2")).agg(F.first("__t").alias("t"))
    joined = texts.join(places.hint("merge"), ["h1", "h2"]).select("h1", "h2", "places", "t")
    return written(joined.mapInArrow(cut, f"{BLOCK_SCHEMA}, h1 long, h2 long"), "runs")


def splitters(blocks: DataFrame) -> list[bytes]:
    """Keys that cut the blocks into ranges of about RANGE contexts, from a sample of OVERSAMPLE first keys a range."""
    n, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges = max(1, n // RANGE)
    share = min(1.0, OVERSAMPLE * ranges / max(1, count))
    keep = F.pmod(F.xxhash64("first", "last"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    weight = 100 * F.col("n") + F.length("payload")
    sample = blocks.filter(keep).select("first", weight.alias("w")).collect()  # bounded by OVERSAMPLE a range
    sample.sort(key=lambda r: bytes(r.first))
    total, below, cuts = sum(r.w for r in sample), 0, []
    for r in sample:
        if len(cuts) + 1 < ranges and below >= (len(cuts) + 1) * total / ranges:
            cuts.append(bytes(r.first))
        below += r.w
    return sorted(set(cuts))


def resolved(blocks: DataFrame, left_first: bool) -> DataFrame:
    """Merge the runs range by range and decide their windows: rows of repeated SPANS, BLOCKS of contexts (other side first) that may
    have equals in other ranges and, in the pass with left contexts first, hashes of such WINDOWS."""
    cuts = splitters(blocks)

    def ranges_of(batches):
        from bisect import bisect_left

        from larkspur.llm.suffixes import KEY, decode_block, encode_block

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for first, last, n, payload in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    lo, hi = _upto(cuts, first), _upto(cuts, last)
                    if lo == hi:
                        out.append((lo, first, last, n, payload))
                        continue
                    rows, meta = decode_block(n, payload, FIELDS, KEY)  # a block that splitters cut
                    keys = [r.tobytes() for r in rows]
                    edges = [0, *(bisect_left(keys, c) for c in cuts[lo:hi]), n]
                    out += [(lo + k, keys[a], keys[b - 1], b - a, encode_block(rows[a:b], meta[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                d, f, e, n, p = zip(*out)
                yield pa.RecordBatch.from_pydict({"dest": pa.array(d, pa.int64()), "first": pa.array(f, pa.binary()), "last": pa.array(e, pa.binary()), "n": pa.array(n, pa.int64()), "payload": pa.array(p, pa.binary())})

    def merge(batches):
        at, held = None, []
        for batch in batches:
            dest = batch.column(0).to_pylist()
            for i, d in enumerate(dest):
                if d != at:
                    if held:
                        yield from _merge_range(held, at, cuts, left_first)
                    at, held = d, []
                held.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
        if held:
            yield from _merge_range(held, at, cuts, left_first)

    sent = blocks.select("first", "last", "n", "payload").mapInArrow(ranges_of, f"dest long, {BLOCK_SCHEMA}")
    n = max(1, min(partitions(blocks.sparkSession) * 2, len(cuts) + 1))
    return written(sent.repartition(n, "dest").sortWithinPartitions("dest").mapInArrow(merge, FOUND_SCHEMA), "found")


def _upto(cuts: list[bytes], key: bytes) -> int:
    from bisect import bisect_right

    return bisect_right(cuts, key)


def _chains(blocks: list[tuple]) -> list[list[tuple[int, bytes]]]:
    """Blocks as few sorted sequences: each goes behind one that ends before it starts, as blocks of one run do."""
    from heapq import heappop, heappush

    ends: list[tuple[bytes, int]] = []
    chains: list[list[tuple[int, bytes]]] = []
    for first, last, n, payload in sorted(blocks, key=lambda b: b[0]):
        if ends and ends[0][0] <= first:
            _, k = heappop(ends)
        else:
            k = len(chains)
            chains.append([])
        chains[k].append((n, payload))
        heappush(ends, (last, k))
    return chains


def _merge_range(held: list[tuple], dest: int, cuts: list[bytes], left_first: bool):
    from larkspur.llm.suffixes import KEY, LoserTree, Stream

    low = cuts[dest - 1] if dest else None
    high = cuts[dest] if dest < len(cuts) else None
    least = 1 if left_first else LENGTH - LEFT  # contexts that agree in fewer primary bytes share no window but d = 0
    keys, lcps, meta = [], [], []
    first = True
    for key, lcp, stream in LoserTree([Stream(c, FIELDS) for c in _chains(held)]):
        lcp = 0 if first else lcp
        first = False
        if lcp < least and len(keys) >= 4096:
            yield from _decide(keys, lcps, meta, low, high, left_first)
            keys, lcps, meta = [], [], []
        keys.append(key)
        lcps.append(lcp)
        meta.append(stream.meta[stream.row])
    if keys:
        yield from _decide(keys, lcps, meta, low, high, left_first)


def _decide(keys, lcps, meta, low, high, left_first):
    from larkspur.llm.suffixes import KEY, TIE, repeated, swapped, swapped_back, window_names

    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
    lcp, meta = np.array(lcps), np.array(meta)
    width = KEY - TIE
    # equal contexts: one of them decides for all
    fresh = lcp < width
    fresh[0] = True
    of = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    size = np.bincount(of)
    least = np.minimum.reduceat(meta[:, 2], heads)
    most = np.maximum.reduceat(meta[:, 3], heads)
    distinct, primary = rows[heads], lcp[heads]
    prime = LEFT if left_first else RIGHT
    twice = repeated(np.minimum(primary, prime), distinct, least, most, left_first)
    twice[size > 1] = True  # every window of a context that occurs again
    d = np.arange(LEFT + 1)
    valid = (meta[:, 2, None] <= d) & (d <= meta[:, 3, None])
    hit = twice[of] & valid
    if hit.any():
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, a = np.nonzero(edge == 1)
        j, b = np.nonzero(edge == -1)
        place = meta[i, 1]
        yield _found(SPANS, len(i), rid=meta[i, 0], lo=place - (b - 1), hi=place - a + LENGTH)
    # windows that agree with a splitter to their depth may have equals beyond it
    depth = np.zeros(len(distinct), np.int64)
    for s in (low, high):
        if s is not None:
            differs = distinct[:, :prime] != np.frombuffer(s, np.uint8)[:prime]
            depth = np.maximum(depth, np.where(differs.any(axis=1), differs.argmax(axis=1), prime))
    if low is None and high is None and not left_first:
        return
    need = d if left_first else LENGTH - d  # windows of d = 0 agree with all in the pass with left contexts first
    inside = (least[:, None] <= d) & (d <= most[:, None])
    open_ = inside & (depth[:, None] >= need)
    some = np.flatnonzero(open_.any(axis=1))
    if not len(some):
        return
    if not left_first:
        # each context once; its copies here are decided, and d ranges widened to theirs
        m = meta[heads[some]].copy()
        m[:, 2], m[:, 3] = least[some], most[some]
        for at in range(0, len(some), RUN):
            part = swapped(distinct[some[at : at + RUN]])
            got = list(zip(*_run_blocks(part, m[at : at + RUN])))
            yield _found(BLOCKS, len(got[0]), first=got[0], last=got[1], n=got[2], payload=got[3])
        return
    straight = swapped_back(distinct[some])
    k, w = np.nonzero(open_[some])
    for at in range(0, len(some), 2048):
        mine = (k >= at) & (k < at + 2048)
        if not mine.any():
            continue
        i, dd = k[mine], w[mine]
        h1, h2 = window_names(straight[at : at + 2048], i - at, dd)
        settled = twice[some[i], dd]
        m = meta[heads[some[i]]]
        # windows settled here speak for themselves only once; others ask
        keep = np.ones(len(i), bool)
        if settled.any():
            s = np.flatnonzero(settled)
            _, uniq = np.unique(np.stack([h1[s], h2[s]]), axis=1, return_index=True)
            keep[s] = False
            keep[s[uniq]] = True
        i, dd, m, h1, h2 = i[keep], dd[keep], m[keep], h1[keep], h2[keep]
        yield _found(WINDOWS, len(i), rid=m[:, 0], lo=m[:, 1] - dd, hi=m[:, 1] - dd + LENGTH, h1=h1, h2=h2)


def repeats(keyed: DataFrame) -> DataFrame:
    """(h1, h2, spans): the byte spans of each text that strings cover which occur elsewhere in it or in another text."""
    spark = keyed.sparkSession
    grams = repeated_grams(keyed)
    places = candidates(keyed, grams)
    release(spark, grams)
    made = runs(keyed, places)
    release(spark, places)
    names = written(made.filter("payload is null").select(F.col("n").alias("rid"), "h1", "h2"), "names")
    once = resolved(made.filter("payload is not null").select("first", "last", "n", "payload"), left_first=False)
    release(spark, made)
    twice = resolved(once.filter(F.col("kind") == BLOCKS), left_first=True)
    windows = twice.filter(F.col("kind") == WINDOWS)
    asked = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1")
    late = windows.select("h1", "h2", "rid", "lo", "hi").join(written(asked, "windows"), ["h1", "h2"]).select("rid", "lo", "hi")
    spans = once.union(twice).filter(F.col("kind") == SPANS).select("rid", "lo", "hi").union(late)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(names, "rid").select("h1", "h2", "spans")


def _fates(keyed: DataFrame, salt) -> DataFrame:
    """(h1, h2, salt, copied, spans) of texts that may lose bytes: copied ones for every salt, the others for their row's."""
    rows = keyed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), salt.alias("salt"), F.length("__t").alias("size")).filter(f"size >= {LENGTH}")
    texts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("salt").alias("salt"))
    both = written(texts, "texts").join(repeats(keyed), ["h1", "h2"], "left").filter("n > 1 or spans is not null")
    copied = F.col("n") > 1
    salts = F.when(copied, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("salt"))
    return both.select("h1", "h2", F.explode(salts).alias("salt"), copied.alias("copied"), F.when(~copied, F.col("spans")).alias("spans"))


def cut_text(text: bytes, lo: np.ndarray, hi: np.ndarray, whole_characters: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """text without the union of the spans, and the maximal removed spans. With whole_characters a span that starts or ends inside
    a character leaves that character."""
    order = np.argsort(lo, kind="stable")
    merged: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    if whole_characters:
        for x in merged:
            while x[0] < len(text) and text[x[0]] & 0xC0 == 0x80:
                x[0] += 1
            while 0 < x[1] < len(text) and text[x[1]] & 0xC0 == 0x80:
                x[1] -= 1
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = max(at, b)
    kept.append(text[at:])
    return b"".join(kept), [(a, b) for a, b in merged if b > a]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs with kept_bytes (the remaining bytes), n_bytes, n_removed, n_spans and kept_sha256."""
    own = ["kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keyed = _keyed(docs.drop(*own), text)
    salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")
    fates = _fates(keyed, salt).withColumnsRenamed({"h1": "__h1", "h2": "__h2", "salt": "__salt", "copied": "__copied", "spans": "__spans"})
    joined = keyed.withColumn("__salt", salt).join(fates, ["__h1", "__h2", "__salt"], "left")
    names = [c for c in keyed.columns if c not in ("__t", "__h1", "__h2")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*names).schema)
    columns = "kept_bytes binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(batches):
        for batch in batches:
            spans_, texts, copied = (batch.column(len(names) + j) for j in range(3))
            for at in range(0, batch.num_rows, 256):
                kept, counts = [], []
                for s, t, c in zip(spans_.slice(at, 256), texts.slice(at, 256), copied.slice(at, 256)):
                    raw = t.as_py()
                    if c.as_py():
                        left, gone = b"", [(0, len(raw))]
                    elif s.is_valid:
                        lo, hi = (np.asarray(s.values.field(k)) for k in (0, 1))
                        left, gone = cut_text(raw, lo, hi, whole_characters)
                    else:
                        left, gone = raw, []
                    kept.append(left)
                    counts.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(kept, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array([c[3] for c in counts], pa.string())], names=[*names, "kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(*names, "__spans", "__t", "__copied").mapInArrow(cut, f"{schema}, {columns}")

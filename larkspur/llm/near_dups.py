"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

Texts with one shingle set are one class, found by a hash aggregation (on the set's size and two 64-bit names) and numbered in a
written table, however many copies there are; all later work is on class numbers. A class's 128 registers make 32 bands of 4: a
pair with similarity 0.8 shares no band with probability 5e-8. In each bucket only the most central class (the one whose buckets
are fullest) is compared with the others, so a group of n near copies costs n comparisons, and each comparison keeps what the class
lacks of its centre and has beyond it. Where that leaves classes of one centre in several components, the exact rest follows from
these two short lists: for x and y of centre c, |x and y| = |c| - |c less x| - |c less y| + |shared members of both lists|, a
matrix product over blocks of members. Members of the centre's largest component aren't compared with each other, only with the
members outside it, so one stray class costs one pass over the others. Every pair that shares a bucket is thus
decided exactly, a large group spreads over tasks, and only one link for each two components of a block is emitted. Links are always
confirmed on whole shingle sets.

Null texts and texts without words are linked with nothing. Repeated rows are copies, and travel as one. Very long texts are compared
whole. A null doc_id counts as larger than all others; several texts may have one doc_id. Ties between centres go to the larger
class number, which decides no link. An empty table gives no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import numbered, release, text_names, written
from larkspur.llm.components import components

REGISTERS, BANDS, ROWS = 128, 32, 4
NO_ID = (1 << 63) - 1
#: Classes that are compared with one centre in a task; classes of one centre in a block, and bytes of their lists.
SPLIT, BLOCK, BLOCK_BYTES = 256, 2048, 1 << 24


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def row_key(doc_id: str, text: str) -> list:
    """i, h1, h2: what names a document: its id (NO_ID for null) and its text's two hashes."""
    h1, h2 = text_names(text)
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("i"), h1.alias("h1"), h2.alias("h2")]


def signatures(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(i, h1, h2, n, cid, cid2, sig): shingle count, the set's two 64-bit names and its signature; sig is null without words."""

    def sign(batches):
        from larkspur.llm.shingles import chunks, set_keys, shingle_sets, super_minhash

        for batch in batches:
            texts = _texts(batch.column(3))
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                x, y = set_keys(sets)
                sig = super_minhash(sets, REGISTERS)
                yield pa.RecordBatch.from_pydict({c: batch.column(j).slice(a, b - a) for j, c in enumerate(("i", "h1", "h2"))} | {
                    "n": pa.array([len(s) for s in sets], pa.int64()), "cid": pa.array(x.view(np.int64)), "cid2": pa.array(y.view(np.int64)),
                    "sig": pa.array([g.tobytes() if len(s) else None for s, g in zip(sets, sig)], pa.binary()),
                })

    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(sign, "i long, h1 long, h2 long, n long, cid long, cid2 long, sig binary")


def memberships(classes: DataFrame) -> DataFrame:
    """(key, size, node) for each band of each class whose bucket has other classes too."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    rows = classes.select("node", "sig", band.alias("band")).select("node", F.xxhash64("band", F.substring("sig", 1 + 4 * ROWS * F.col("band"), F.lit(4 * ROWS))).alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return written(rows.join(full, "key"), "buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(c, x): each bucket's most central class with each of its others."""
    score = written(buckets.groupBy("node").agg(F.sum(F.log2("size")).alias("score")), "scores")
    scored = written(buckets.join(score, "node"), "scored")
    centre = written(scored.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("c")), "centres")
    return written(scored.join(centre, "key").filter("c <> node").select("c", F.col("node").alias("x")).distinct(), "pairs")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, linked, na, nb, lists) for each of ``pairs`` (c, x): a = c, b = x, whether 100 * intersection >= percent * union of their
    shingle sets, their sizes, and the shingles that one has and the other hasn't, a's first (``lacks`` of them).

    Each class is looked up by one document, of which equal rows are one; its text travels once for each centre it is compared with,
    to that centre's task. A centre of many pairs is repeated for every SPLIT of them, so no task has them all."""
    parts = pairs.groupBy("c").agg(F.expr(f"cast(count(*) div {SPLIT} as int)").alias("top"))
    centres = written(parts, "parts")
    members = pairs.join(centres, "c").select(F.col("x").alias("node"), "c", F.pmod(F.xxhash64("x"), F.col("top") + 1).cast("int").alias("part"), F.lit(1).alias("member"))
    heads = centres.select(F.col("c").alias("node"), "c", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("part"), F.lit(0).alias("member"))
    roles = written(members.union(heads), "roles").join(classes.select("node", "cid", "cid2", "rep.*"), "node")
    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").cast("binary").alias("text")).groupBy("i", "h1", "h2").agg(F.first("text").alias("text"))
    # roles grow with the corpus: never broadcast, whatever their size
    dealt = rows.join(written(roles, "roles-by-doc").hint("merge"), ["i", "h1", "h2"]).select("c", "part", "member", "node", "cid", "cid2", "text").repartition("c", "part").sortWithinPartitions("c", "part", "member")

    def compare(batches):
        from larkspur.llm.shingles import beyond, set_keys, shingle_sets

        at, head = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                c, p, member, node = (part.column(j).to_pylist() for j in range(4))
                sets = shingle_sets(_texts(part.column(6)), k)
                x, y = set_keys(sets)
                named = (x.view(np.int64) == part.column(4).to_numpy()) & (y.view(np.int64) == part.column(5).to_numpy())
                got = []
                for j, s in enumerate(sets):
                    if not named[j]:  # another text that shares id and hashes
                        continue
                    if not member[j]:
                        at, head = (c[j], p[j]), s
                    elif at == (c[j], p[j]):
                        lacks, more = beyond(head, s), beyond(s, head)
                        both = len(s) - len(more)
                        got.append((c[j], node[j], 100 * both >= percent * (len(head) + len(s) - both), len(head), len(s), len(lacks), lacks.tobytes() + more.tobytes()))
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got), kinds)], names=["a", "b", "linked", "na", "nb", "lacks", "lists"])

    return written(dealt.mapInArrow(compare, "a long, b long, linked boolean, na long, nb long, lacks long, lists binary"), "checked")


def _products(left: list[np.ndarray], right: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """How many members each left list shares with each right list."""
    out = np.zeros((len(left), len(right)), np.float32)
    n = [len(x) for x in left] + [len(x) for x in right]
    row = np.repeat(np.arange(len(n)), n)
    _, place, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    keep = times[place] > 1
    row, place = row[keep], (np.cumsum(times > 1) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for at in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(place, [at, at + width])
        m = np.zeros((len(n), width), np.float32)
        m[row[a:b], place[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def rest_links(checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes of one centre that stand in different components so far, one for each two components of a block."""
    held = checked.join(found, checked["b"] == found["node"], "left").select("a", "b", F.coalesce("root", "b").alias("root"), "na", "nb", "lacks", "lists")
    held = written(held, "held")
    per_root = held.groupBy("a", "root").agg(F.count("*").alias("n"), F.sum(F.length("lists")).alias("w"))
    most = lambda c: F.max_by(c, F.struct("n", "root"))
    open_ = per_root.groupBy("a").agg(most("root").alias("big"), most("n").alias("big_n"), most("w").alias("big_w"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("roots")).filter("roots > 1")
    blocks_ = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_BYTES), F.lit(1)).cast("int")
    open_ = open_.select("a", "big", blocks_(F.col("big_n"), F.col("big_w")).alias("bigs"), blocks_(F.col("n") - F.col("big_n"), F.col("w") - F.col("big_w")).alias("smalls"))
    rows = held.join(written(open_, "open"), "a").withColumn("inner", F.col("root") == F.col("big"))
    rows = rows.withColumn("mine", F.when(F.col("inner"), F.pmod(F.xxhash64("b"), F.col("bigs"))).otherwise(F.col("bigs") + F.pmod(F.xxhash64("b"), F.col("smalls"))).cast("int"))
    # the largest component's blocks meet only the others' blocks
    first = F.when(F.col("inner"), F.col("bigs")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("bigs") + F.col("smalls") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    dealt = rows.select("a", "i", "j", "mine", "b", "root", "na", "nb", "lacks", "lists").repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")

    def decide(at, held):
        left, right = [r for r in held if r[0] == at[1]], [r for r in held if r[0] == at[2]]
        if not left or not right or len({r[2] for r in held}) < 2:
            return None
        lists = lambda part: [np.frombuffer(r[6], np.int64) for r in part]
        column = lambda part, f: np.array([r[f] for r in part], np.int64)
        both = held[0][3] - column(left, 5)[:, None] - column(right, 5) + _products(lists(left), lists(right)).astype(np.int64)
        ok = 100 * both >= percent * (column(left, 4)[:, None] + column(right, 4) - both)
        x, y = np.nonzero(ok & (column(left, 2)[:, None] != column(right, 2)))
        if not len(x):
            return None
        _, one = np.unique(np.stack([column(left, 2)[x], column(right, 2)[y]]), axis=1, return_index=True)
        return pa.RecordBatch.from_pydict({"a": pa.array(column(left, 1)[x[one]]), "b": pa.array(column(right, 1)[y[one]])})

    def blocks(batches):
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(f).to_pylist() for f in range(10))):
                if row[:3] != at:
                    if at and (out := decide(at, held)):
                        yield out
                    at, held = row[:3], []
                held.append(row[3:])
        if at and (out := decide(at, held)):
            yield out

    return written(dealt.mapInArrow(blocks, "a long, b long").distinct(), "rest")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group, i, h1, h2): component_id is the smallest doc_id reachable over links, kept whether
    it is the document's own; group numbers the components with words, i, h1 and h2 name the document (``row_key``). The bands hold for
    percent of 80 or more."""
    if percent < 80:
        raise ValueError("bands are laid out for similarities of 0.8 or more")
    spark = docs.sparkSession
    signed = written(signatures(docs, k, doc_id, text), "signatures")
    one = signed.filter("n > 0").groupBy("n", "cid", "cid2").agg(F.min(F.struct("i", "h1", "h2")).alias("rep"), F.first("sig").alias("sig"))
    classes = numbered(one, "node", "classes")
    buckets = memberships(classes)
    release(spark)
    pairs = star_pairs(buckets)
    release(spark, buckets)
    checked = verified(docs, classes, pairs, k, percent, doc_id, text)
    links = checked.filter("linked").select("a", "b")
    found = components(links)
    rest = rest_links(checked, found, percent)
    if not rest.isEmpty():
        found = components(links.union(rest))
    at = classes.select("n", "cid", "cid2", F.col("node").alias("id"), F.col("rep.i").alias("i")).join(found, F.col("id") == found["node"], "left")
    at = written(at.select("n", "cid", "cid2", "i", F.coalesce("root", "id").alias("group")), "roots")
    least = written(at.groupBy("group").agg(F.min("i").alias("component")), "least")
    label = written(at.drop("i").join(least, "group"), "labels")
    worded = signed.filter("n > 0").select("i", "h1", "h2", "n", "cid", "cid2").join(label, ["n", "cid", "cid2"]).select("i", "h1", "h2", "n", "component", "group")
    empty = signed.filter("n = 0").select("i", "h1", "h2", "n", F.col("i").alias("component"), F.lit(None).cast("long").alias("group"))
    of = lambda c: F.nullif(c, F.lit(NO_ID))
    out = worded.union(empty).select(of("i").alias("doc_id"), F.col("n").alias("n_shingles"), of("component").alias("component_id"), "group", "i", "h1", "h2")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(labelled: DataFrame) -> DataFrame:
    """(i, h1, h2): one document of each group of ``near_duplicates``, the smallest, and each document without words."""
    named = F.struct("i", "h1", "h2")
    of_group = labelled.filter("group is not null").groupBy("group").agg(F.min(named).alias("x")).select("x.*")
    return of_group.union(labelled.filter("group is null").select("i", "h1", "h2").distinct())


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with exactly one row of each near-duplicate group: of equal (doc_id, text) rows, the one whose other columns are least."""
    keep = survivors(near_duplicates(docs, k, percent, doc_id, text))
    others = [c for c in docs.columns if c not in (doc_id, text)]
    rows = docs.select(*row_key(doc_id, text), F.col(text).alias("__text"), F.struct(*others).alias("__others") if others else F.lit(1).alias("__others"))
    rows = rows.groupBy("i", "h1", "h2").agg(F.first("__text").alias("__text"), F.min("__others").alias("__others")).join(keep, ["i", "h1", "h2"], "left_semi")
    kind = docs.schema[doc_id].dataType
    named = {doc_id: F.nullif("i", F.lit(NO_ID)).cast(kind), text: F.col("__text")} | {c: F.col("__others")[c] for c in others}
    return rows.select(*(named[c].alias(c) for c in docs.columns))

"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bitpack, licenses, mixing, near_dups, packing, quality, sharding, suffix_dedup, token_counts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string"


def make(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "er", "Or", "é", "st."]) for _ in range(rng.randrange(1, 4)))
    text = lambda k: "".join(word() + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(k))
    passage, rows = text(70), []
    for i in range(n):
        t = text(rng.randrange(0, 120))
        if i % 5 == 0:
            t += passage + text(10)
        rows.append((i, t, f"s{min(i % 9, 5)}"))
    base = text(200)
    rows += [(100 + i, base if i < 4 else " ".join(w if j != 9 * i else "zz" for j, w in enumerate(base.split(" "))), "s1") for i in range(12)]
    rows += [(200, None, "s1"), (201, "", None), (202, "   \n", None), (203, "word", "s2"), (204, text(5000), "s0"), (7, rows[7][1], rows[7][2])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).withColumn("size", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("h", F.lit(2)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path


def brute_cut(texts, length=200):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("size,block", [(50_000, 256), (40, 8)])
def test_suffix_dedup(spark, docs, none, monkeypatch, size, block):
    monkeypatch.setattr(suffix_dedup, "RANGE", size)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = make()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    want = sorted((r[0], *w) for r, w in zip(rows, brute_cut([(r[1] or "").encode() for r in rows])))
    assert got == want and sum(w[2] for w in want) > 1000
    if size > 40:
        assert suffix_dedup.remove_repeats(none).count() == 0
        whole = suffix_dedup.remove_repeats(docs, whole_characters=True).collect()
        assert all(bytes(r.kept_bytes).decode() is not None for r in whole)


def test_license_scan(spark, none):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. ALL rights, reserved! cc by"), (2, None), (3, ""), (4, "GNU General Public\nLicense, version 3"), (5, "all rights are reserved by cc"), (6, "x " * 9000 + "All rights reserved" + " y" * 9000),
        (7, "Released under the MIT License."), (7, "Released under the MIT License."), (8, "cc cc by by cc éby cc_by"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("w", F.lit(1))
    got = sorted(map(tuple, licenses.report(licenses.scan(d)).collect()))
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for g, (i, t) in zip(got, rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(p, n) for n, k in phrases.items() for p in range(len(w)) if w[p : p + len(k.split())] == k.split()]
        want = (i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({n for _, n in at})))
        assert g[:6] == want and set(filter(None, g[5].split(","))) <= set(g[6].split(",")) and 0 <= g[7] <= 1
    assert got[0][6] == "cc-by,cc-by-nc,reserved" and got[6][6] == "mit" and got[3][6] == "gpl,gpl-3"
    assert licenses.report(licenses.scan(none)).count() == 0


def test_sharding(spark, docs, none):
    rows, n = make(), 5
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    got = sharding.shard(docs, n, size).collect()
    sizes = lambda t: len((t or "").encode()) + 8
    key = lambda r: (int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16) if r[1] is not None else -1, r[0])
    total, below, want = sum(sizes(r[1]) for r in rows), Counter(), []
    for r in rows:
        before = sum(sizes(x[1]) for x in rows if key(x) < key(r))
        want.append((r[0], before * n // total))
    assert sorted((r.doc_id, r.shard) for r in got) == sorted(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == {s for _, s in want}  # a text longer than a shard leaves one empty
    assert sharding.shard(none, n, size).count() == 0
    same = spark.createDataFrame([(i, "copy" * 50, "s") for i in range(400)], SCHEMA)
    per = Counter(r.shard for r in sharding.shard(same, 4, size).collect())
    assert per == {0: 100, 1: 100, 2: 100, 3: 100}


def brute_components(rows, k):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k,split,block", [(4, 256, 512), (5, 2, 3)])
def test_near_duplicates(spark, docs, none, monkeypatch, k, split, block):
    monkeypatch.setattr(near_dups, "SPLIT", split)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    got = near_dups.near_duplicates(docs, k).collect()
    want = brute_components(make(), k)
    assert len(got) == len(make()) and all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in got)
    if k == 4:
        assert near_dups.near_duplicates(none, k).count() == 0


def test_near_duplicate_chains(spark):
    """Each text is near the next only: the star round can't link all, the rest does."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[8 * i : 8 * i + 100]), "s") for i in range(30)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert {r.component_id for r in got} == {0}


def test_mixing(spark, docs, none):
    rows = make()
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by = Counter()
    for r in rows:
        by[r[2]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(by.values()), set()
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(2 * by[s] for s in fixed)) / sum(w[s] for s in rest)
        over = {s for s in rest if level * w[s] > 2 * by[s]}
        if not over:
            break
        fixed |= over
    target = {s: 2 * by[s] if s in fixed else level * w[s] for s in names}
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken", "first_position").collect()), key=repr) == sorted(((r.doc_id, r.taken, r.first_position) for r in got), key=repr)
    placed = mixing.placements(mixing.mix(docs)).collect()
    assert all(size(r.text) == r.words for r in placed) and sum(r.words for r in placed) == sum(taken.values())
    assert mixing.mix(none).count() == 0


def test_packing(spark, docs, none, path):
    rows, p = make(), path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p)
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    got = packing.pack_documents(docs, p, 0, 1024).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4")))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    for d, x in pieces.items():
        ids = [i for _, a in sorted(x, key=lambda y: y[0]) for i in a.tolist()]
        assert sorted(ids) == sorted(i for (k, v), n in want.items() if k == d for i in v * n)
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    used = sum(r.length for r in got)
    assert len(sequences) <= used // 1024 + 2 and packing.pack_documents(none, p).count() == 0


def test_bit_packed_files(spark, docs, none, path):
    rows, p = make(), path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p)
    want, at = [], 0
    for i, text, _ in sorted(((r[0], r[1] or "", 0) for r in rows)):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, bitpack.read_tokens(spark, bitpack.write_tokens(docs, p, 2)).collect())) == sorted(want)
    assert bitpack.read_tokens(spark, bitpack.write_tokens(none, p, 2)).count() == 0


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.3, 0.1]) for _ in range(6)]) for i in range(90)] + [(95, None), (96, [None, 1.0]), (97, [float("nan")] * 6), (98, [float("inf")]), (99, [0.5, 0.5]), (100, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = sorted(map(tuple, topk.top_k(topk.quantised(d, "vec_id", "embedding"), F.col("id") % 20 == 0, 7).collect()))
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        s = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:7]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(topk.quantised(d.limit(0), "vec_id", "embedding"), F.col("id") % 20 == 0).count() == 0
    assert len(topk.top_k(topk.quantised(d.filter("vec_id in (0, 1, 2)"), "vec_id", "embedding"), F.col("id") % 20 == 0).collect()) == 2


def test_quality(spark, docs, none):
    rows = make()
    got = quality.judge(docs).collect()
    want = Counter()
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        repeat = len({j + k for v in at.values() if len(v) > 1 for j in v for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))] += 1
    assert Counter((r.doc_id, *(r[c] for c in quality.FEATURES), r.base_failed) for r in got) == want
    assert all(not r.kept or not r.base_failed for r in got) and {r.doc_id: r.kept for r in got}[204] is not None
    assert quality.judge(none).count() == 0
    lines = spark.createDataFrame([(1, "a|b\na|b\n \na|b #", "s"), (2, "x y z x y z y z x", "s")], SCHEMA)
    assert [(r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(lines).orderBy("doc_id").collect()] == [(4, 1, 0), (0, 0, 9)]


def test_token_counts(spark, docs, none, path):
    p = path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p)
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in make()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, p)).cache()
    for r in sums.collect():
        assert r.n_docs == n.count(r.length) and r.docs_at_least == sum(x >= r.length for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in n) and r.share_up_to == pytest.approx(sum(x <= r.length for x in n) / len(n))
    assert sums.count() == len(set(n))
    assert tuple(token_counts.at_limit(sums, 100).first()) == (sum(min(x, 100) for x in n), sum(x > 100 for x in n))
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(none, p)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(30)]
    passage = " ".join(word() for _ in range(60))
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(clean)]
    rows += [(40, clean[0], "en", "s0", 1), (41, clean[1].replace(clean[1].split()[50], "qq"), "en", "s1", 1), (42, "a b c " * 100, "en", "s2", 1), (43, None, None, None, None)]
    rows += [(50 + i, " ".join(word() for _ in range(150)) + " " + passage, "en", "s3", 1) for i in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "t").mkdir()
    d.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    after, df = {}, spark.read.parquet(str(tmp_path / "t" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path / "t")).cache()
        after[name] = df
    ids = lambda name: {r.doc_id for r in after[name].collect()}
    assert ids("quality rules") == {*range(30), 40, 41, 50, 51}
    assert ids("near duplicates") == {*range(30), 50, 51}
    texts = {r.doc_id: r.text for r in after["suffix dedup"].collect()}
    assert all(passage not in texts[i] for i in (50, 51)) and texts[3] == clean[3]
    assert all(after[n].columns == list(corpus_pipeline.COLUMNS) for n, _ in corpus_pipeline.STAGES[:-1])
    assert ids("mixing") <= ids("suffix dedup") and after["mixing"].count() > 32
    assert ids("packing") == ids("mixing")


def repeated_rows(n=300):
    """Equal rows, rows with one id and several texts, null ids."""
    word = lambda i: "w" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + str(i)
    text = " ".join(map(word, range(90)))
    other = [" ".join(word(100 * j + i) for i in range(90)) for j in range(1, 6)]
    rows = [(7, text, "s0")] * n + [(i, text, "s1") for i in (8, 9)]
    rows += [(7, t, "s2") for t in other[:3]] + [(None, other[3], "s0")] * 40 + [(None, other[4], None)] * 3 + [(None, None, None)] * 2 + [(5, "", "s1")] * 3
    return rows


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame(repeated_rows(), SCHEMA).withColumn("votes", F.lit(1)).withColumn("posterior", F.lit("x")).repartition(4).cache()


def test_repeated_rows_suffix_dedup(spark, copies, monkeypatch):
    rows, seen = repeated_rows(), []
    made = suffix_dedup.runs
    monkeypatch.setattr(suffix_dedup, "runs", lambda *a: seen.append(made(*a)) or seen[-1])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(copies).collect()), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute_cut([(r[1] or "").encode() for r in rows]))), key=repr)


def test_repeated_rows_near_duplicates(spark, copies):
    got = near_dups.near_duplicates(copies, 5)
    assert got.count() == len(repeated_rows()) and got.filter("doc_id in (8, 9)").select("component_id").distinct().collect()[0][0] == 7
    one = near_dups.one_of_each(copies, 5)
    assert one.columns == copies.columns
    assert sorted(map(repr, one.select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame({(r[0], r[1]) for r in repeated_rows() if r[0] not in (8, 9)}, "doc_id long, text string").collect()))


def test_stray_class_meets_linked_ones_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    w = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w[:k] + [f"x{i}"] + w[k + 1 :]), "s") for i, k in enumerate([3 * j % 190 for j in range(120)])]
    rows += [(500 + i, " ".join(w[:150] + [f"y{j}" for j in range(45)]) + f" z{i}", "s") for i in range(2)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5).collect()
    want = brute_components(rows, 5)
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in got) and len(got) == len(rows)


def test_repeated_rows_sharding(spark, copies):
    size, n = F.coalesce(F.octet_length("text"), F.lit(0)) + 8, 6
    per, slots = Counter(), defaultdict(list)
    for r in sharding.shard(copies, n, size).collect():
        per[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert set(per) == set(range(n)) and max(per.values()) - min(per.values()) <= 2 * 700
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(repeated_rows())


def test_repeated_rows_packing(spark, path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 64)
    d = spark.createDataFrame([(1, "a b c", "s")] * 2000, SCHEMA).repartition(4)
    got = packing.pack_documents(d, path("byte_bpe_50k.json"), 0, 64).collect()
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 2000 and len(groups) == 32 and max(groups.values()) < 200
    again = packing.pack_documents(d, path("byte_bpe_50k.json"), 0, 64).collect()
    assert Counter((r.sequence_id, r.offset) for r in got) == Counter((r.sequence_id, r.offset) for r in again)


def test_repeated_rows_files(spark, copies, path):
    from tokenizers import Tokenizer

    p = path("word_bpe_49k.json")
    t = Tokenizer.from_file(p)
    n = {x: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in {r[1] for r in repeated_rows()}}
    got = sorted(bitpack.read_tokens(spark, bitpack.write_tokens(copies, p, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in repeated_rows()), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and sum(r.n_tokens for r in got) == sum(n[r[1]] for r in repeated_rows())


def test_repeated_queries_top_k(spark):
    rows = [(20, [0.5, 0.25])] * 3 + [(i, [i / 50, 0.1]) for i in range(1, 20)] + [(None, [1.0, 1.0])] * 2
    got = topk.top_k(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), F.col("id") % 20 == 0, 5).collect()
    score = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))
    others = [rows[1], rows[2], *rows[3:]]
    best = sorted(others, key=lambda r: (-score(rows[0][1], r[1]), r[0] is None, r[0] or 0))[:5]
    want = [(20, k + 1, r[0], score(rows[0][1], r[1])) for k, r in enumerate(best)]
    assert sorted(map(tuple, got), key=repr) == sorted(want * 3, key=repr)


def test_repeated_rows_quality_mix_counts(spark, copies, path):
    rows = repeated_rows()
    got = quality.judge(copies).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(len({(r.kept, r.posterior) for r in got if r.text == t}) == 1 for t in {r[1] for r in rows})
    mixed = mixing.mix(copies).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in mixed)
    assert licenses.report(licenses.scan(copies)).count() == len(rows)
    assert token_counts.length_histogram(copies, path("byte_bpe_50k.json")).agg(F.sum("n_docs")).first()[0] == len(rows)


def test_cut_keeps_the_text_before(spark):
    rows = [(i, f" a\nb\t c{i}\n\nd  e f\n g", f"s{i % 2}") for i in range(41)]
    placed = mixing.placements(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) and len(r.text.split()) == r.words for r in placed) and any(r.words < r.size for r in placed)


def plain_em(patterns):
    """The same model written on arrays: posterior of good by pattern."""
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    g = np.where((v == -1).any(1), 0.05, 0.95)
    for _ in range(quality.ROUNDS):
        prior = ((n * g).sum() + 1) / (n.sum() + 2)
        logit = np.full(len(n), np.log(prior / (1 - prior)))
        for r in range(v.shape[1]):
            part = {x: (0.5 + (n * g)[v[:, r] == x].sum(), 0.5 + (n * (1 - g))[v[:, r] == x].sum()) for x in (-1, 0, 1)}
            of = [sum(p[j] for p in part.values()) for j in (0, 1)]
            for x, keep in ((-1, min), (1, max)):
                logit[v[:, r] == x] += keep(0.0, np.log(part[x][0] / of[0] * of[1] / part[x][1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -600, 600)))
        if abs(new - g).max() < 1e-12:
            return new
        g = new
    return g


def test_quality_posteriors_against_a_plain_em(docs):
    got = quality.judge(docs).collect()
    patterns = sorted(Counter(tuple(r.votes) for r in got).items())
    want = dict(zip([p for p, _ in patterns], plain_em(patterns)))
    assert all(r.posterior == pytest.approx(want[tuple(r.votes)], abs=1e-6) and r.kept == (not r.base_failed and r.posterior >= quality.KEEP) for r in got)


def test_pipeline_keeps_one_of_equal_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "en", "s0", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 1), (0, texts[0], "de", "s1", 1), (None, texts[1], "en", "s0", 1)] + [(None, " ".join(word() for _ in range(100)), "en", None, 1)] * 4
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__others", F.lit(1)).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    df, sizes = spark.read.parquet(str(tmp_path / "t" / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, str(tmp_path / "t")).cache()
        sizes[name] = df.count()
    assert sizes["near duplicates"] == 13 and all(len(r.text) > 300 for r in df.collect()) and {r.doc_id for r in df.collect()} == {*range(12), None}
    spark.createDataFrame([], df.schema).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0

"""The numpy and Python kernels, without Spark."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import bitpack, packing, quality, shingles, suffix_dedup, suffixes


@pytest.fixture(scope="module")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from larkspur.llm.tokens import WordEncoder

    return [WordEncoder(public.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]


def test_word_encoder_equals_the_tokenizer(tokenizers):
    rng = random.Random(1)
    bits = ["a", "Hello", "thner,", "x.", "it's", "É", "ß", "Ünder.", "日本", "3.14", "don't", "#$%", "cá", "İx", "Σας", "<|endoftext|>", ".", ",", "ŉa"]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\xa0", "　", "\x1c", "\r\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += ["", " ", "\n", "a", " a", "a ", "  a  b  ", "x\n\ny", "x \n\n  y z"]
    for e in tokenizers:
        for t in texts:
            assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_encoder_encodes_a_run_of_marks_once(tokenizers, monkeypatch):
    rng = random.Random(8)
    marks = ["", ".", ",", "%%%", ",###", "!!", "'", "''.", "<|", "|>", "--", ')"']
    cores = ["".join(rng.choice("abstEéßÜ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    made = [c + m for c in cores for m in rng.sample(marks, 3)]
    text = "".join(w + rng.choice("   \n") for w in made) + "end"
    for e in tokenizers:
        whole, want = [], e.tokenizer.encode(text, add_special_tokens=False).ids
        with monkeypatch.context() as m:
            m.setattr(e, "raw", lambda t, raw=e.raw: whole.append(t) or raw(t))
            e.words.clear()
            assert np.frombuffer(e.encode(text), e.dtype).tolist() == want
        assert not whole  # no word went through the whole tokenizer


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def grams(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_shingle_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab A\n\té ") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "  ", "a", "A a a", "a b c d", "a a a a a a"]
    for k in (4, 5):
        for t, s in zip(texts, shingles.shingle_sets([t.encode() for t in texts], k)):
            assert len(s) == len(grams(t, k)) and (np.diff(s.astype(object)) > 0).all()
    a, b = shingles.shingle_sets([b"A b\nc  d e", b"a B c d E"], 4)
    assert a.tolist() == b.tolist()
    alone, joint = shingles.shingle_sets([b"one two"], 4)[0], shingles.shingle_sets([b"x y z w v", b"one two", b"q"], 4)[1]
    assert alone.tolist() == joint.tolist()


def test_super_minhash_estimates():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.8):
        errors = []
        for n in (30, 400):
            for _ in range(40):
                both = int(2 * n * j / (1 + j))
                u = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                a, b = np.sort(u[:n]), np.sort(u[n - both : 2 * n - both])
                s = shingles.super_minhash([a, b], 128)
                errors.append((s[0] == s[1]).mean() - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    x = shingles.super_minhash([np.array([7, 9], np.uint64), np.zeros(0, np.uint64), np.array([7, 9], np.uint64)], 128)
    assert (x[0] == x[2]).all()


def test_first_fit_decreasing_against_a_plain_scan():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))]
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (b == len(room))
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert dict(enumerate(packing.first_fit_decreasing(sizes, 100))) == want


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = bitpack.pack_bits(ids, bits)
    assert len(raw) == -(-1000 * bits // 8) and (bitpack.unpack_bits(raw, 1000, bits) == ids).all()
    w, parts = bitpack.PartWriter(f"file://{tmp_path}/x/part.bits", bits, "1"), [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 3, 70_000, 150_000, 1)]
    for i, p in enumerate(parts):
        w.add(None if i == 1 else i, p)
    w.close()
    r = bitpack.PartReader(f"file://{tmp_path}/x/part.bits")
    assert r.null.tolist() == [0, 1, 0, 0, 0] and all((r.document(i) == p).all() for i, p in enumerate(parts))
    whole = np.concatenate(parts)
    assert (r.ids(65_000, 140_000) == whole[65_000:140_000]).all()


def test_anchors_divide_all_windows(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(700))) for _ in range(40)] + [b"a" * 1000, b"ab" * 300, b"", b"x" * 199, b"y" * 200]
    for piece in (suffixes.PIECE, 250):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        seen = {}
        for held in suffixes.pieces(texts):
            for d, p, lo, hi, _ in zip(*suffixes.whole(*suffixes.anchors(held))):
                assert 0 <= lo <= hi <= 100
                for q in range(lo, hi + 1):
                    assert (d, p - q) not in seen
                    seen[d, p - q] = p
        assert sorted(seen) == sorted((i, p) for i, t in enumerate(texts) for p in range(len(t) - 199))


class Rows:
    """Stands for a table and keeps the function that a task runs over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        raise StopIteration(f)


def peak(f):
    """What f returns and the MB it held at most."""
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


@pytest.mark.parametrize("sizes", [[2000] * 1500, [3_000_000]])
def test_anchors_of_a_batch_in_little_memory(sizes):
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in sizes]
    want = list(zip(*(np.concatenate(x) for x in zip(*(suffixes.whole(*suffixes.anchors([(i, 0, t)])) for i, t in enumerate(texts))))))
    batch = pa.RecordBatch.from_pydict({"h1": pa.array(range(len(texts))), "h2": pa.array(range(len(texts))), "t": pa.array(texts, pa.binary())})
    shingles._powers[:] = [x[:2].copy() for x in shingles._powers]
    for made in (lambda: suffix_dedup.repeated_grams(Rows()), lambda: suffix_dedup.candidates(Rows(), None)):
        with pytest.raises(StopIteration) as e:
            made()
        got, most = peak(lambda: list(e.value.value([batch])))
        assert most < 120, most
    found = [(r["h1"], r["place"] >> 14, r["place"] >> 7 & 127, r["place"] & 127, r["gram"] % (1 << 64)) for b in got for r in b.to_pylist()]
    assert sorted(found) == sorted(tuple(int(y) for y in x) for x in want)


def test_run_blocks_hold_no_second_run():
    rows = np.random.default_rng(9).integers(97, 99, (20_000, suffixes.KEY), dtype=np.uint8)
    meta = np.arange(80_000).reshape(-1, 4)
    got, keys, order = [], [], suffixes.sort_run(rows)
    _, most = peak(lambda: [got.append(b[2]) or (keys.append(suffixes.decode_block(b[2], b[3], 4, suffixes.KEY)) if len(got) < 4 else None) for b in suffix_dedup._run_blocks(rows, meta)])
    assert sum(got) == len(rows) and (np.concatenate([k for k, _ in keys]) == rows[order][:768]).all() and (np.concatenate([m for _, m in keys]) == meta[order][:768]).all()
    assert most < rows.nbytes / 1e6 / 2, most


def test_loser_tree_merges_and_keeps_common_prefixes():
    rng = random.Random(5)
    runs, keys = [], []
    for r in range(7):
        rows = np.array([[rng.choice(b"ab") for _ in range(suffixes.KEY)] if rng.random() < 0.5 else [97] * suffixes.KEY for _ in range(rng.randrange(0, 60))], np.uint8).reshape(-1, suffixes.KEY)
        rows = rows[suffixes.sort_run(rows)]
        meta = np.arange(len(rows)).reshape(-1, 1) + 1000 * r
        keys += [bytes(x) for x in rows]
        runs.append(suffixes.Stream([(min(16, len(rows) - i), suffixes.encode_block(rows[i : i + 16], meta[i : i + 16])) for i in range(0, len(rows), 16)], 1))
    got = [(k, l) for k, l, _ in suffixes.LoserTree(runs)]
    assert [k for k, _ in got] == sorted(keys)
    assert all(l == suffixes.common(a, b, 0) for (a, _), (b, l) in zip(got, got[1:]))


def plain_prefixes(rows):
    return [suffixes.common(bytes(a), bytes(b), 0) if i else 0 for i, (a, b) in enumerate(zip(rows[:1].tolist() + rows.tolist(), rows.tolist()))]


@pytest.mark.parametrize("n", [0, 1, 2, 4096, 4097, 4098, 8193, 9000])
def test_prefixes_against_a_plain_loop(n):
    rows = np.random.default_rng(7).integers(97, 99, (n, 8), dtype=np.uint8)
    rows = rows[suffixes.sort_run(rows)]
    assert suffixes.prefixes(rows).tolist() == plain_prefixes(rows)


@pytest.mark.parametrize("left_first", [False, True])
def test_repeated_across_blocks_against_a_plain_count(left_first):
    n, prime, rest = 9000, *((suffixes.LEFT, suffixes.RIGHT) if left_first else (suffixes.RIGHT, suffixes.LEFT))
    # places 2i - 1 and 2i differ in their last sorted byte only, and all other sides are equal
    rows = np.frombuffer(b"".join(b"%04d" % ((i + 1) // 2) + b"m" * (prime - 5) + b"ab"[i % 2 == 0 :][:1] + b"o" * rest for i in range(n)), np.uint8).reshape(n, -1)
    low, high = np.full(n, 97 if left_first else 0), np.full(n, 100 if left_first else 3)
    got = suffixes.repeated(np.array(plain_prefixes(rows[:, :prime])), rows, low, high, left_first)
    for d in range(low[0], high[0] + 1):
        mine = d if left_first else suffixes.LENGTH - d
        windows = [bytes(r[:mine]) + bytes(r[prime : prime + suffixes.LENGTH - mine]) for r in rows]
        times = Counter(windows)
        assert got[:, d].tolist() == [times[w] > 1 for w in windows]
    assert got[4096].any() and got[8192].any()


def test_em_learns_which_rules_to_trust():
    rng = random.Random(6)
    seen, truth = {}, {}
    for _ in range(4000):
        good = rng.random() < 0.8
        v = tuple((1 if good == (rng.random() < a) else -1) if rng.random() < 0.9 else 0 for a in (0.97, 0.95, 0.93, 0.55))
        seen[v] = seen.get(v, 0) + 1
        truth.setdefault(v, []).append(good)
    post = quality.fit(sorted(seen.items()))
    right = sum(sum(g == (post[v] >= 0.5) for g in gs) for v, gs in truth.items())
    assert right / 4000 > 0.95 and quality.fit([]) == {}

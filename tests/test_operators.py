"""Hand-computed fixtures for the scoring operators."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import params, text
from larkspur.operators import ranking, retrieval


def test_bm25_weights_and_scores(spark):
    docs = spark.createDataFrame([("d1", ["red", "bolt", "red"]), ("d2", ["red", "plate"]), ("d3", [])], "doc string, toks array<string>")
    index = retrieval.bm25_index(docs, "doc", "toks")
    w = {(r.term, r.doc): r.weight for r in index.collect()}
    assert w["red", "d1"] == pytest.approx(0.527555, abs=1e-6) and w["red", "d2"] == pytest.approx(0.434457, abs=1e-6) and w["bolt", "d1"] == pytest.approx(0.738981, abs=1e-6)
    q = retrieval.query_terms(spark.createDataFrame([(1, ["red", "red", "bolt"])], "q int, toks array<string>"), "q", "toks")
    s = {r.doc: (r.score, r.n_terms) for r in retrieval.bm25_scores(q, index).collect()}
    assert s["d1"] == (pytest.approx(1.266536, abs=1e-6), 2) and s["d2"][0] == pytest.approx(0.434457, abs=1e-6) and "d3" not in s
    small = retrieval.bm25_index(docs, "doc", "toks", spark.createDataFrame([("red",)], "term string"))
    assert {r.term for r in small.collect()} == {"red"}


def test_location_prior(spark):
    log = spark.createDataFrame([(1, 1)] * 3 + [(1, 2), (2, 2)], "sloc int, iloc int")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (7, 7), (7, 1)], "sloc int, iloc int")
    shares = retrieval.log_shares(log)
    p = {(r.sloc, r.iloc): (r.p, r.lp) for r in retrieval.location_prior(shares, pairs).collect()}
    assert p[1, 1] == (pytest.approx(2 / 3), pytest.approx(-0.405465, abs=1e-6)) and p[1, 2][1] == pytest.approx(-1.098612, abs=1e-6)
    assert p[7, 7][0] == pytest.approx(0.77) and p[7, 1][0] == pytest.approx(0.138)
    assert {(r.sloc, r.iloc): r.p for r in retrieval.location_prior(shares, pairs, False).collect()}[7, 1] == pytest.approx(0.6)


def test_token_bayes(spark):
    log = spark.createDataFrame([(["a"], "m1"), (["a", "b"], "m1"), (["b"], "m2")], "toks array<string>, mc string")
    mcs = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "mc string")
    got = {r.mc: r.lift for r in retrieval.token_bayes(log, mcs, spark.createDataFrame([(1, ["a", "b"])], "q int, toks array<string>")).collect()}
    assert got == {"m1": pytest.approx(0.202733, abs=1e-6), "m2": pytest.approx(-0.235002, abs=1e-6), "m3": pytest.approx(-0.693147, abs=1e-6)}


def test_neighbour_weights(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.85), (1, 3, 0.8)], "q int, doc int, score double")
    assert [r.weight for r in retrieval.neighbours(s).orderBy("doc").collect()] == pytest.approx([0.665241, 0.244728, 0.090031], abs=1e-6)


def test_parameters(spark):
    s = "мусор Вид услуги Красота, здоровье Тип услуги Маникюр Тип услуги автосервиса ТО Вид услуги"
    row = spark.createDataFrame([(s,)], "s string").select(params.parse(F.col("s")).alias("p"))
    got = row.select("p", params.as_map(F.col("p")).alias("m"), params.service_text(F.col("p")).alias("t")).first()
    assert [(x.key, x.value) for x in got.p] == [("Вид услуги", "Красота, здоровье"), ("Тип услуги", "Маникюр"), ("Тип услуги автосервиса", "ТО"), ("Вид услуги", "")]
    assert got.m["Вид услуги"] == ["Красота, здоровье", ""] and got.t == "Красота, здоровье Маникюр ТО"


def test_text_functions(spark):
    row = spark.createDataFrame([("Ёлка-2 Repairé ÄB 3D", None)], "s string, p double")
    got = row.select(text.tokens(F.col("s")).alias("t"), text.price(F.col("p")).alias("a"), text.price(F.lit(0.0)).alias("b"), text.price(F.lit(100.0)).alias("c")).first()
    assert got.t == ["елка", "2", "repair", "b", "3d"] and got.a == 0 and got.b == pytest.approx(math.log(2)) and got.c == pytest.approx(4.624973, abs=1e-6)
    assert row.select(text.without_title(F.lit("abc. def"), F.lit("abc")).alias("x")).first().x == "def"


def test_quota_assembly(spark):
    rows = [(q, d, s, svc, good) for q in (0, 1) for d, s, svc, good in (("a", 0.9, True, False), ("b", 0.8, True, False), ("c", 0.1, False, True), ("d", 0.7, True, False), ("e", 0.85, False, False))]
    x = spark.createDataFrame(rows, "q int, doc string, score double, in_service boolean, good boolean")
    q = spark.createDataFrame([(0, False, True), (1, True, False), (2, True, False)], "q int, service_only boolean, any_category boolean")
    assert {r.q: r.answer for r in ranking.assemble(x, q, 3, 1).collect()} == {0: "a e c", 1: "a b d", 2: ""}


def test_recall_and_ranks(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2)], "q int, doc int, rank int")
    rel = spark.createDataFrame([(1, 2), (1, 9), (2, 4)], "q int, doc int")
    assert ranking.recall(ranked, rel, 2).agg(F.avg("recall")).first()[0] == 0.75
    x = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, 1.0), (1, 4, float("nan")), (1, 5, None)], "q int, doc int, v double")
    assert [r.rk_v for r in ranking.add_ranks(x, "q", ["v"]).orderBy("doc").collect()] == [1, 1, 3, None, None]


def test_fallback_keeps_order(spark):
    first = spark.createDataFrame([(1, d, 1.0 / d) for d in range(1, 6)], "q int, doc int, score double")
    second = spark.createDataFrame([(1, 2, -5.0)], "q int, doc int, score double")
    assert [r.doc for r in ranking.with_fallback(second, first).orderBy(F.desc("score")).collect()] == [2, 1, 3, 4, 5]


def test_char_grams(spark):
    assert spark.range(1).select(retrieval.char_grams(F.lit("ab c")).alias("g")).first().g == [" ab", "ab ", " c "]


def vectors(spark, n, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = [(i, rng.choice([-1.0, 0.5, 0.25], 6).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc long, dv array<double>")


def test_nearest_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from larkspur.operators import dense

    monkeypatch.setattr(dense, "CORPUS_BLOCK", 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    rows, corpus = vectors(spark, 40)
    asked = spark.createDataFrame([(i, v, i if i else -1) for i, v in rows[:5]], "q long, qv array<double>, own long")
    top, m = dense.nearest(asked, corpus, 6)
    got = {q: [] for q in range(5)}
    for r in top.orderBy("q", "rank").collect():
        got[r.q].append((r.doc, r.score))
    for q, v in rows[:5]:
        all_ = [(i, float(np.round(np.dot(v, w), 9))) for i, w in rows if not (q and i == q)]
        assert got[q] == sorted(all_, key=lambda x: (-x[1], x[0]))[:6]
        stats = m.filter(f"q = {q}").first()
        assert stats.n == len(all_) and stats.pop == pytest.approx(np.std([s for _, s in all_])) and stats.samp == pytest.approx(np.std([s for _, s in all_], ddof=1))
    assert dense.nearest(asked.limit(0), corpus, 3)[0].count() == 0 and dense.nearest(asked, corpus.limit(0), 3)[0].count() == 0


def test_located_adds_the_prior(spark):
    import numpy as np

    from larkspur.operators import dense

    log = spark.createDataFrame([("a", "a")] * 3 + [("a", "b"), ("b", "b")], "sloc string, iloc string")
    rows, corpus = vectors(spark, 30)
    places = {i: "abc"[i % 3] for i, _ in rows}
    items = corpus.join(spark.createDataFrame(list(places.items()), "doc long, iloc string"), "doc")
    cnt, n_s, share = retrieval.log_shares(log)
    items = items.join(share, "iloc", "left").select("doc", "dv", "iloc", F.coalesce("share", F.lit(retrieval.UNSEEN)).alias("base"))
    seen = cnt.groupBy("sloc").agg(F.collect_list(F.struct("iloc", "cnt")).alias("cnts"))
    asked = spark.createDataFrame([(0, rows[0][1], -1, "a", 2.0), (1, rows[1][1], -1, "c", 1.0)], "q long, qv array<double>, own long, sloc string, scale double").join(n_s, "sloc", "left").join(seen, "sloc", "left")
    got = dense.located(asked, items, [("x", 8, "scale", 1.0, 0.5)])
    pairs = spark.createDataFrame([(s, i) for s in "ac" for i in "abc"], "sloc string, iloc string")
    lp = {(r.sloc, r.iloc): r.lp for r in retrieval.location_prior((cnt, n_s, share), pairs).collect()}
    for q, sloc, scale in ((0, "a", 2.0), (1, "c", 1.0)):
        s = {i: float(np.round(scale * np.round(np.dot(rows[q][1], v), 9) + 0.5 * lp[sloc, places[i]], 9)) for i, v in rows}
        want = sorted(s, key=lambda i: (-s[i], i))[:8]
        assert [r.doc for r in got.filter(f"q = {q}").orderBy("rank").collect()] == want


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc string, toks array<string>")
    assert retrieval.bm25_index(docs, "doc", "toks").count() == 0
    nulls = spark.createDataFrame([("d1", None), ("d2", ["a"])], "doc string, toks array<string>")
    assert [r.term for r in retrieval.bm25_index(nulls, "doc", "toks").collect()] == ["a"]
    log = spark.createDataFrame([], "sloc int, iloc int")
    assert retrieval.location_prior(retrieval.log_shares(log), spark.createDataFrame([(1, 1)], "sloc int, iloc int")).first().p == 0.77
    none = spark.createDataFrame([], "q int, doc int, r int, y int")
    e = ranking.eval_rank(none, spark.createDataFrame([(1, 2)], "q int, n_rel long"), spark.createDataFrame([(1, 1.0)], "q int, w double")).first()
    assert e.r50 == 0 and e.r35w == 0


def test_rank_metrics_and_models(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 10, 1, 1), (1, 11, 40, 1), (2, 12, 2, 0), (2, 13, 60, 1)], "q int, doc int, r int, y int")
    sizes, w = spark.createDataFrame([(1, 4), (2, 1)], "q int, n_rel long"), spark.createDataFrame([(1, 3.0), (2, 1.0)], "q int, w double")
    e = ranking.eval_rank(ranked, sizes, w).first()
    assert (e.r50, e.r35, e.r50w, e.r35w) == (0.25, 0.125, 0.375, 0.1875)
    x = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "q int, seg string")
    got = {r.q: r.w for r in ranking.segment_weights(x, spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "seg string")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 3.0, 4: 0.0}
    models = [ranking.Linear(["f", "g"], [1.0, -2.0]), ranking.Linear(["f", "g"], [3.0, 0.5])]
    ranking.write_models(spark, models, str(tmp_path / "m"))
    back = ranking.read_models(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([(1.0, 2.0)], "f double, g double")
    assert ranking.predict(rows, back, ["f", "g"]).first().score == ranking.predict(rows, models, ["f", "g"]).first().score == 0.5

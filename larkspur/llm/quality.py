"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule gives +1 (good), -1 (bad) or 0 (abstains). The corpus is counted by vote pattern (at most 3 to the
number of rules rows, whatever its size); on that table EM estimates how often good and bad documents get
each vote of each rule, and the share of good documents; a document is kept when its posterior probability of
being good is at least ``KEEP``. The features and votes are DataFrame expressions.

Null and empty texts have no words; repeated rows each count; an empty table gives no rows. Columns named as the
result's own are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import written

KEEP = 0.5
ROUNDS = 200
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with FEATURES, base_failed, and n_lines, n_letters, n_distinct, which only rules read (n_letters: word
    characters but punctuation)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    x = docs.drop(*FEATURES, "base_failed", "n_lines", "n_letters", "n_distinct", "__w", "__l", "__s").withColumn("__w", F.array_remove(F.split(t, SPACE), ""))
    x = x.withColumn("__l", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    w, n = F.col("__w"), F.size("__w")
    grams = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda a, i: F.struct(F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    x = x.withColumn("__s", F.sort_array(grams))
    s = F.col("__s")
    same = lambda g, j: F.coalesce(F.get(s, j)["h"] == g["h"], F.lit(False))
    hit = lambda g, i: same(g, i + 1) | same(g, i - 1)
    places = F.array_sort(F.transform(F.filter(s, hit), lambda g: g["i"]))
    x = x.withColumn("__p", places)
    p = F.col("__p")
    covered = F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    out = x.withColumn("n_words", n.cast("long"))
    out = out.withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).withColumn("n_lines", F.size("__l").cast("long"))
    out = out.withColumn("n_repeat_words", covered.cast("long"))
    out = out.withColumn("n_letters", F.length(F.translate(t, " \t\n\x0b\x0c\r.,;:!?'\"()[]{}-_/\\#*$%&|<>=+@~^`", "")).cast("long"))
    out = out.withColumn("n_distinct", F.size(F.array_distinct(w)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("__w", "__l", "__s", "__p")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 50),
        "repeats": _vote(10 * c("n_repeat_words") <= 3 * n, 10 * c("n_repeat_words") > 5 * n),
        "symbols": _vote(50 * c("n_symbols") <= n, 10 * c("n_symbols") > n),
        "lines": _vote(20 * c("n_dup_lines") <= c("n_lines"), 5 * c("n_dup_lines") > c("n_lines")),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n)),
        "marks": _vote(100 * c("n_letters") >= 94 * c("word_chars"), 100 * c("n_letters") < 90 * c("word_chars")),
        "variety": _vote(10 * c("n_distinct") >= 2 * n, 20 * c("n_distinct") < n),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern (votes, documents), by EM.

    Conditionally independent votes with smoothed counts; it starts from documents that
    no rule votes against (each kind of junk breaks a rule or two and pleases the others), and a rule's vote may not come to speak for the other side, so that "good" keeps its meaning."""
    if not patterns:
        return {}
    k = len(patterns[0][0])
    post = {v: 0.05 if -1 in v else 0.95 for v, _ in patterns}
    for _ in range(rounds):
        good = sum(n * post[v] for v, n in patterns)
        total = sum(n for _, n in patterns)
        prior = (good + 1) / (total + 2)
        odds = []
        for r in range(k):
            seen = {x: [0.5, 0.5] for x in (-1, 0, 1)}
            for v, n in patterns:
                seen[v[r]][0] += n * post[v]
                seen[v[r]][1] += n * (1 - post[v])
            all_ = [sum(seen[x][j] for x in seen) for j in (0, 1)]
            log = {x: math.log(seen[x][0] / all_[0]) - math.log(seen[x][1] / all_[1]) for x in seen}
            odds.append({-1: min(log[-1], 0.0), 0: 0.0, 1: max(log[1], 0.0)})
        now = {v: 1 / (1 + math.exp(-max(-600.0, min(600.0, math.log(prior / (1 - prior)) + sum(odds[r][x] for r, x in enumerate(v)))))) for v, _ in patterns}
        moved = max(abs(now[v] - post[v]) for v in now)
        post = now
        if moved < 1e-12:
            break
    return post


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in ``carry``) with FEATURES, base_failed, posterior and kept. The features are computed once and
    written with the columns carried; the votes are counted from that table."""
    spark, names = docs.sparkSession, list(rules())
    own = {*FEATURES, "base_failed", "votes", "posterior", "kept"}
    carried = [c for c in (docs.columns if carry is None else carry) if c not in own]
    voted = features(docs.drop("votes", "posterior", "kept"), text).withColumn("votes", F.array(*(v.cast("int") for v in rules().values())))
    table = written(voted.select(*carried, *FEATURES, "base_failed", "votes"), "quality")
    counts = table.groupBy("votes").count().collect()  # at most 3 ** len(names) rows
    assert len(counts) <= 3 ** len(names)
    post = fit(sorted((tuple(r.votes), r["count"]) for r in counts))
    known = spark.createDataFrame([(list(v), round(p, 9)) for v, p in post.items()], T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("posterior", T.DoubleType())]))
    return table.join(F.broadcast(known), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))

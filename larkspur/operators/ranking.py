"""Within-query ranks, answer assembly by quotas, recall, and linear models (``boosting`` has the ranker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_ranks(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """rk_<column>: the rank from the highest, ties to the least rank; NaN and null stay unranked."""
    out = rows
    for c in columns:
        x = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))
        w = Window.partitionBy(group).orderBy(x.desc_nulls_last())
        out = out.withColumn(f"rk_{c}", F.when(x.isNotNull(), F.rank().over(w)))
    return out


def gaps(rows: DataFrame, group: str, score: str) -> DataFrame:
    """rank, z-score (+1e-6) and gap to the best, in the group."""
    w = Window.partitionBy(group)
    by = Window.partitionBy(group).orderBy(F.desc(score), "doc")
    z = (F.col(score) - F.avg(score).over(w)) / (F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0)) + 1e-6)
    return rows.withColumn("s_rank", F.row_number().over(by)).withColumn("s_z", z).withColumn("s_gap", F.col(score) - F.max(score).over(w))


def assemble(rows: DataFrame, queries: DataFrame, limit: int = 50, reserve: int = 15) -> DataFrame:
    """(q, answer): the best items of each query, ids joined by spaces.

    rows: (q, doc, score, in_service, good); queries: (q, service_only, any_category). Queries for services only drop other items; for queries
    of any category the ``reserve`` best other items that are good matches by themselves are kept, and the rest fills up; a query
    without rows gets ''."""
    x = rows.join(queries, "q").filter(~F.col("service_only") | F.col("in_service"))
    other = F.col("any_category") & ~F.col("in_service") & F.col("good")
    held = Window.partitionBy("q", "other").orderBy(F.desc("score"), "doc")
    x = x.withColumn("other", other).withColumn("held", F.col("other") & (F.row_number().over(held) <= reserve))
    best = Window.partitionBy("q").orderBy(F.desc("held"), F.desc("score"), "doc")
    x = x.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    lists = x.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda s: s["doc"].cast("string")), " ")
    return queries.select("q").join(lists, "q", "left").select("q", F.coalesce(joined, F.lit("")).alias("answer"))


def with_fallback(second: DataFrame, first: DataFrame, far: float = 1e6) -> DataFrame:
    """First-pass rows with the second pass's score; rows it hasn't scored come after, in their old order."""
    s = second.select("q", "doc", F.col("score").alias("s2"))
    return first.join(s, ["q", "doc"], "left").select("q", "doc", F.coalesce("s2", F.col("score") - far).alias("score"))


def recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(q, recall): the share of a query's relevant items in its first k; ranked: (q, doc, rank), relevant: (q, doc)."""
    hit = relevant.join(ranked.filter(F.col("rank") <= k).select("q", "doc", F.lit(1).alias("hit")), ["q", "doc"], "left")
    return hit.groupBy("q").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def segment_weights(queries: DataFrame, target: DataFrame) -> DataFrame:
    """(q, seg, w, v, b): queries (q, seg) reweighted to the segments of target (seg): w = b / v, the shares; 0 for a segment target lacks."""
    share = lambda x, n: x.groupBy("seg").agg(F.count("*").alias("n")).crossJoin(F.broadcast(x.agg(F.count("*").alias("all")))).select("seg", (F.col("n") / F.col("all")).alias(n))
    x = queries.join(share(queries, "v"), "seg").join(share(target, "b"), "seg", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    return x.select("q", "seg", (F.col("b") / F.col("v")).alias("w"), "v", "b")


def eval_rank(ranked: DataFrame, sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """One row r50, r50w, r35, r35w: mean recall in the first 50 and 35, plain and weighted; relevant items outside ``ranked`` (q, r, y) are misses.

    sizes: (q, n_rel); weights: (q, w)."""
    hits = ranked.filter("y = 1").groupBy("q").agg(*(F.count(F.when(F.col("r") <= k, 1)).alias(f"h{k}") for k in (50, 35)))
    x = sizes.join(weights, "q").join(hits, "q", "left").na.fill(0, ["h50", "h35"])
    h = {k: F.col(f"h{k}") / F.col("n_rel") for k in (50, 35)}
    return x.agg(*(e for k in (50, 35) for e in (F.avg(h[k]).alias(f"r{k}"), (F.sum(h[k] * F.col("w")) / F.sum("w")).alias(f"r{k}w"))))


def metric_rows(metrics: DataFrame, stage: str, name: str) -> DataFrame:
    """(stage, name, metric, value) of a one-row table, rounded to four digits, as a metric log keeps them."""
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in metrics.columns))
    return metrics.select(F.explode(rows).alias("x")).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "x.*")


def answer_report(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counts that an answer table (q, answer) must pass: queries, distinct queries, the longest list, lists that repeat an id, lists
    that aren't numbers parted by single spaces, ids that aren't in corpus (id)."""
    x = answers.withColumn("ids", F.split("answer", " "))
    foreign = x.select(F.explode("ids").alias("id")).filter("id <> ''").join(corpus, "id", "left_anti").agg(F.count("*").alias("n_foreign"))
    bad = ~F.col("answer").rlike("^([0-9]+( [0-9]+)*)?$")
    counts = x.agg(F.count("*").alias("n_queries"), F.countDistinct("q").alias("n_ids"), F.max(F.size("ids")).cast("long").alias("longest"), F.count(F.when(F.size("ids") != F.size(F.array_distinct("ids")), 1)).alias("n_repeating"), F.count(F.when(bad, 1)).alias("n_bad_form"))
    return counts.crossJoin(F.broadcast(foreign))  # one row each


def hash_pick(rows: DataFrame, n: int) -> DataFrame:
    """(q, doc): n of each query's rows, in the order of a hash of both."""
    w = Window.partitionBy("q").orderBy(F.md5(F.concat(F.col("doc").cast("string"), F.lit("|"), F.col("q").cast("string"))), "doc")
    return rows.select("q", "doc").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


class Linear:
    """A linear ranker's coefficients; ``write`` and ``read_models`` keep them as a table."""

    def __init__(self, features: list[str], coefficients: list[float]):
        self.features, self.coefficients = list(features), [float(c) for c in coefficients]


def write_models(spark, models: list[Linear], path: str) -> None:
    rows = [(i, f, c) for i, m in enumerate(models) for f, c in zip(m.features, m.coefficients)]
    spark.createDataFrame(rows, "model int, feature string, coefficient double").coalesce(1).write.mode("overwrite").parquet(path)


def read_models(spark, path: str) -> list[Linear]:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.model)  # a row for each feature and model
    return [Linear([r.feature for r in rows if r.model == i], [r.coefficient for r in rows if r.model == i]) for i in sorted({r.model for r in rows})]


def predict(rows: DataFrame, models: list, features: list[str]) -> DataFrame:
    """rows with score: the mean of the models' linear scores."""
    score = F.lit(0.0)
    for m in models:
        for f, c in zip(m.features, m.coefficients):
            score = score + F.lit(float(c) / len(models)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return rows.withColumn("score", score)

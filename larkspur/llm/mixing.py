"""Mixing sources to target weights along a curriculum.

Each source's weight changes over training time t (0 to 1) as w * (1 + a * (2 t - 1)), whose integral
is w. A source's share of its cumulative demand by time t is then t + a * (t * t - t); inverting that gives the
training position of the source's x-th token, and documents are range-sorted by position. A source that must
give more than it has is run through again, up to ``MAX_TIMES``.

Everything is DataFrame operations. Sums before a document are taken in two levels (hash buckets of a source, as many as
leave about ``BUCKET_DOCS`` documents of the corpus in each, then inside a bucket), so no source is handled by one task. Ties in
the order of a source go to the smaller doc_id, then the smaller size; equal rows may stand in any order, as they take alike. Null texts have size 0; null is a
source of its own, last; repeated rows each count; an empty table gives no rows. Columns named as the
result's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
#: Slope of each weight's schedule: heavy sources lead, light ones come late.
SLOPES = (-0.5, 0.0, 0.5)
MAX_TIMES = 2
#: Documents in a bucket, if one source had them all; hashes have 60 bits.
BUCKET_DOCS, HASH_BITS = 4096, 60

OWN = ("size", "source_size", "target", "taken", "first_position", "second_position")


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, numerator: int = 3, denominator: int = 2) -> DataFrame:
    """sizes: (src, source_size), a row for each source, src '' for null. Adds weight, slope and target: the total
    (numerator/denominator of all sizes) shared by weight, none above MAX_TIMES its source's size."""
    in_order_ = ((F.col("src") == "").cast("int"), "src")
    rank = Window.orderBy(*in_order_)
    k = F.pmod(F.row_number().over(rank) - 1, F.lit(len(WEIGHTS))).cast("int") + 1
    x = sizes.withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), k).cast("long")).withColumn("slope", F.element_at(F.lit(list(SLOPES)), k))
    x = x.withColumn("cap", MAX_TIMES * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), *in_order_)
    all_ = Window.partitionBy()
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(all_))
    level = (numerator * F.col("total") - denominator * F.col("before")) / (denominator * F.col("rest")).cast("double")
    x = x.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    x = x.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(all_))  # the first open one: beyond it they fall
    goal = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return x.select("src", "source_size", "weight", "slope", goal.alias("target"))


def position(x: Column, demand: Column, slope: Column) -> Column:
    """When the x-th of ``demand`` tokens is due: the inverse of t + slope * (t * t - t) at x / demand."""
    u, b = x / demand, 1 - slope
    return F.round(2 * u / (b + F.sqrt(b * b + 4 * slope * u)), 9)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", words: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, taken (words taken, repeats counted) and the positions of their first and
    second run (null if not taken). In a source documents stand in a fixed random order, by a hash of doc_id. words: the
    documents' word counts, if they are known."""
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")))
    x = docs.withColumn("__size", word_count(text) if words is None else words).drop(*OWN, "src", "h", "bucket").withColumnRenamed("__size", "size")
    bits = max(0, HASH_BITS - max(1, docs.count() // BUCKET_DOCS).bit_length())
    x = x.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")))  # '' is null
    x = x.withColumn("h", F.conv(F.substring(key, 1, 15), 16, 10).cast("long")).withColumn("bucket", F.shiftright("h", bits).cast("int"))
    sums = x.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.join(goals, "src").select("src", "bucket", "bucket_start", "source_size", "slope", "target")
    x = x.join(offsets, ["src", "bucket"])  # dealt as the window below needs it
    here = Window.partitionBy("src", "bucket").orderBy("h", doc_id, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("start", F.col("bucket_start") + F.sum("size").over(here) - F.col("size")).withColumn("demand", F.round("target").cast("long"))
    clip = lambda left: F.greatest(F.lit(0), F.least(F.col("size"), left))
    first, second = clip(F.col("demand") - F.col("start")), clip(F.col("demand") - F.col("source_size") - F.col("start"))
    x = x.withColumn("taken", first + second)
    x = x.withColumn("first_position", F.when(first > 0, position(F.col("start"), F.col("demand"), F.col("slope"))))
    x = x.withColumn("second_position", F.when(second > 0, position(F.col("start") + F.col("source_size"), F.col("demand"), F.col("slope"))))
    return x.drop("src", "h", "bucket", "bucket_start", "slope", "start", "demand")


def in_order(mixed: DataFrame, doc_id: str = "doc_id", position: str = "first_position") -> DataFrame:
    """Range-sorted by position; documents that aren't taken come last."""
    by = (F.col(position).asc_nulls_last(), F.col(doc_id).asc_nulls_last())
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)


def placements(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each run of a document, at its position, with the words that run takes: a document that
    the demand ends in is cut after its last taken word, the text before that as it is."""
    runs = F.array(
        F.struct(F.col("first_position").alias("position"), F.least("taken", "size").alias("words")),
        F.struct(F.col("second_position").alias("position"), (F.col("taken") - F.col("size")).alias("words")),
    )
    x = mixed.withColumn("run", F.explode(F.filter(runs, lambda r: r["words"] > 0))).withColumn("position", F.col("run.position")).withColumn("words", F.col("run.words"))
    blank = r"[\x20\x09-\x0D]+"
    rest = F.element_at(F.split(F.col(text), blank, F.col("words").cast("int") + 1 + F.col(text).rlike("^" + blank).cast("int")), -1)  # from the first word left out
    cut = F.rtrim(F.left(F.col(text), F.length(text) - F.length(rest)), F.lit(" \t\n\x0b\x0c\r"))
    return x.withColumn(text, F.when(F.col("words") >= F.col("size"), F.col(text)).otherwise(cut)).drop("run")

"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Each Python task counts the lengths it has seen and sends one row for each length, so the shuffle
grows with distinct lengths and not with documents. Null and empty texts have length 0; repeated
rows count each time; other columns are ignored; an empty table gives an empty histogram. The histogram is written once, so
the corpus is encoded once however often it is read; very long texts are encoded whole.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import written

#: Lengths in a block of the suffix sums; blocks are summed apart, so no task sees the whole histogram.
BLOCK = 4096


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length, n_docs): how many documents encode to each length with the tokenizer file at ``path``."""

    def count(batches):
        from larkspur.llm.tokens import encoder

        enc, seen = encoder(path), Counter()
        for batch in batches:
            for x in batch.column(0):
                s = x.as_py()
                seen[len(enc.encode(s)) // enc.dtype.itemsize if s else 0] += 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    part = docs.select(F.col(text).cast("string")).mapInArrow(count, "length long, n long")
    return written(part.groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L: documents and tokens at L, of documents at least that long, tokens left when
    every document is cut at L (``truncated_tokens``), and the share of documents up to L."""
    hist = hist.withColumn("block", F.expr(f"length div {BLOCK}")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), F.sum("d").over(Window.partitionBy()).alias("all_d"), F.sum("t").over(Window.partitionBy()).alias("all_t"))
    here = Window.partitionBy("block").orderBy(F.desc("length"))
    x = hist.join(blocks, "block").withColumn("docs_at_least", F.sum("n_docs").over(here) + F.col("d_later")).withColumn("tokens_at_least", F.sum("n_tokens").over(here) + F.col("t_later"))
    return x.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_d")).alias("share_up_to"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when documents are cut at ``limit``, which need not be a length that occurs."""
    cut = F.least("length", F.lit(limit)) * F.col("n_docs")
    return sums.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_tokens"), F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of all documents doesn't exceed."""
    return sums.filter(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))

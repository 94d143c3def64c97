"""From raw documents to packed training sequences: five stages, each one of the operators in larkspur.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; between stages the rows are written as Parquet and read
again. All but the last return the columns of ``documents``; columns beyond these are left out, so none can clash. Empty tables pass through
all stages and give no rows. Very long texts are one row everywhere. A stage's input is deleted once the stage after it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import mixing, near_dups, packing, quality, suffix_dedup
from larkspur.llm.common import read, release, written
from larkspur.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision model keeps; null and empty texts have too few words and go, repeated rows are judged alike."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Of equal (doc_id, text) rows, null ids among them,
    one row stays; documents without words are groups of their own."""
    return near_dups.one_of_each(docs.select(*COLUMNS), SHINGLE, PERCENT)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that repeat; characters stay whole, a null text becomes an empty one. No row goes."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    return cut.withColumn("text", F.col("kept_bytes").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each run of a document that the mix takes, in training order: none, one or two. Texts without words aren't taken; a null
    source is a source of its own."""
    mixed = mixing.in_order(mixing.placements(mixing.mix(docs.select(*COLUMNS))), "doc_id", "position")
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; each row is a document, whatever ids repeat."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix dedup", suffix_dedup_stage),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: EM and the tokenizer have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(spark, before)
        docs = before = out
    return docs

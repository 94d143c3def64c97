"""Scans and sinks. Parquet scans stay lazy, so Catalyst prunes columns and pushes filters into them."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An answer or metric table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, empty ones kept as ''."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def table_or_write(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first where it is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A stage table of this application, made once for each input folder and then read by every query that needs it."""
    key = hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:16]
    return table_or_write(spark, f"{work_dir(spark)}/stages-{key}/{name}", make)


def vector_table_report(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Integrity of a stored vector table: rows, rows of another dimension, rows off the unit sphere by more than 0.001."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.agg(F.count("*").alias("n_rows"), F.count(F.when(F.size(column) != dim, 1)).alias("n_bad_dim"), F.count(F.when(F.abs(norm - 1) > 1e-3, 1)).alias("n_bad_norm"))

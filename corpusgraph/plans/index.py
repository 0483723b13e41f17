"""Lexical indexes of tables that Spark reads, made once and kept for the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import lexical
from corpusgraph.plans.lineage import written

_MADE: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what a kept index is valid for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def indexed(spark: SparkSession, path: str, id_col: str, text_cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of the Parquet table at ``path``; the first call builds and writes them."""
    key = (spark.sparkContext.applicationId, path, id_col, text_cols, signature(spark, path))
    if key not in _MADE:
        # Texts are tokenised once; the rows' lengths come from the same pass.
        plain = written(lexical.inverted(spark.read.parquet(path), id_col, list(text_cols)), "postings-plain")
        # Ranges are found by a pass of their own, which reads what is written.
        made = written(lexical.laid_out(plain), "postings")
        empty = spark.read.parquet(path).select(F.col(id_col).alias("id"))
        sizes = made.select("id", "n_tokens").distinct()
        _MADE[key] = made, written(empty.join(sizes, "id", "left").select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "lengths")
    return _MADE[key]

"""Git history as DataFrames: a marker of what was read, and changed line ranges.

The driver lists commit ids only. Executors run ``git diff-tree`` for each commit on the shared
repository; the patches become rows of lines, and which path and commit a range belongs to is
found by column functions.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = 200
COMMITS_A_TASK = 25


def _run(root: str, *command: str, timeout: int = 30) -> bytes:
    """What Git prints, or nothing where it fails."""
    try:
        return subprocess.run(("git", "-C", root, *command), capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return b""


def commit_ids(root: str, history: int = HISTORY) -> list[str]:
    return _run(root, "rev-list", f"--max-count={history}", "HEAD").decode("ascii", "replace").split()


def history_marker(root: str) -> str | None:
    """Changes whenever HEAD moves or a shallow clone gets deeper."""
    ids = commit_ids(root)
    return "/".join((ids[0], ids[-1], str(len(ids)))) if ids else None


def patch_lines(spark: SparkSession, root: str, commits: list[str]) -> DataFrame:
    """(commit, at, line): the file and range lines of each commit's patch, numbered."""
    real = os.path.realpath(root)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for commit in b.column("commit").to_pylist():
                patch = _run(real, "-c", "core.quotepath=off", "diff-tree", "--root", "-r", "-p", "-U0", "--no-renames", "--no-ext-diff", "--no-commit-id", commit)
                # Content lines begin with a sign; a removed "++ x" can't pass for a file line, since
                # file lines come in a header before the first range only.
                kept, header = [], False
                for line in patch.decode("utf-8", "replace").split("\n"):
                    header = line.startswith("diff --git ") or (header and not line.startswith("@@"))
                    if line.startswith("@@ ") or (header and line.startswith("+++ ")):
                        kept.append(line)
                yield pa.RecordBatch.from_arrays([pa.array([commit] * len(kept), pa.string()), pa.array(range(len(kept)), pa.int32()), pa.array(kept, pa.string())], names=["commit", "at", "line"])

    ids = spark.createDataFrame([(c,) for c in commits], "commit string").repartition(max(1, -(-len(commits) // COMMITS_A_TASK)), "commit")
    return ids.mapInArrow(read, "commit string, at int, line string")


def ranges_of(lines: DataFrame) -> DataFrame:
    """(commit, path, start, end) of the ranges of new lines; deleted files have none."""
    path = F.last(F.when(F.col("line").startswith("+++ "), F.substring("line", 5, 1 << 20)), ignorenulls=True).over(Window.partitionBy("commit").orderBy("at"))
    part = lambda k: F.regexp_extract("line", r"^@@ -\S+ \+([0-9]+),?([0-9]*) @@", k)
    ranges = lines.withColumn("path", path).filter(F.col("line").startswith("@@ ") & F.col("path").startswith("b/"))
    start, length = part(1).cast("int"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(1))
    # A range of no new lines marks the place where lines were removed.
    return ranges.select("commit", F.regexp_replace(F.substring("path", 3, 1 << 20), "\t$", "").alias("path"), start.alias("start"), (start + F.greatest(length, F.lit(1)) - 1).alias("end")).filter("start is not null")


def changed_ranges(spark: SparkSession, root: str, history: int = HISTORY) -> DataFrame:
    return ranges_of(patch_lines(spark, root, commit_ids(root, history)))

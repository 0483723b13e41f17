"""Repository files as DataFrames: listing, confinement, globs, binary and size filters."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.text import content_hash, matches_glob
from corpusgraph.schema import MAX_FILE_BYTES

# Folders and files that are never indexed.
EXCLUDED = ("**/node_modules/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/target/**", "**/.git/**", "**/vendor/**", "**/*.min.js", "**/*.lock", "**/.corpusgraph/**")
IGNORE_FILE = ".corpusgraphignore"
PROBE = 4096
#: Files that one task opens.
FILES_A_TASK = 500
LISTING = "path string, size long, modified_ns long"


def git_listing(root: str) -> list[str] | None:
    """Tracked and unignored paths, or None outside of a Git working tree."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-coz", "--exclude-standard"], capture_output=True, text=True, timeout=30, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return [p for p in done.stdout.split("\0") if p]


def folder_listing(root: str) -> list[str]:
    """All files below a folder, hidden ones too; linked folders aren't entered."""
    return [os.path.relpath(os.path.join(at, name), root) for at, _, names in os.walk(root) for name in names]


def ignore_patterns(root: str) -> tuple[str, ...]:
    file = Path(root, IGNORE_FILE)
    lines = file.read_text(errors="replace").splitlines() if file.is_file() else []
    return tuple(s for s in map(str.strip, lines) if s and not s.startswith("#"))


def confined(root: str, paths: list[str]) -> list[str]:
    """Paths whose real place is inside the root."""
    real = os.path.realpath(root)
    return [p for p in paths if os.path.realpath(os.path.join(root, p)).startswith(real + os.sep)]


def listed_rows(root: str) -> list[tuple[str, int, int]]:
    """(path, size, modified) of every regular file that is confined to the root."""
    found, paths = [], git_listing(root)
    for path in confined(root, folder_listing(root) if paths is None else paths):
        try:
            at = os.stat(os.path.join(root, path))
        except OSError:
            continue
        if os.path.isfile(os.path.join(root, path)):
            found.append((path, at.st_size, at.st_mtime_ns))
    return found


def listing(spark: SparkSession, root: str, *, include=("**",), exclude=(), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size, modified_ns) of the files to read, by globs and sizes alone."""
    rows = listed_rows(os.path.realpath(root))
    files = spark.createDataFrame(rows, LISTING).repartition(max(1, -(-len(rows) // FILES_A_TASK)), "path")
    files = files.filter((F.col("size") > 0) & (F.col("size") <= max_bytes) & ~matches_glob(F.col("path"), [*EXCLUDED, *exclude, *ignore_patterns(root)]))
    return files if tuple(include) == ("**",) else files.filter(matches_glob(F.col("path"), include))


def contents(files: DataFrame, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content) as bytes, read by the executors from the shared folder ``root``.

    A file that has gone, or has grown beyond the limit, since it was listed gives no row.
    """
    real = os.path.realpath(root)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            paths, held = [], []
            for path in b.column("path").to_pylist():
                try:
                    with open(os.path.join(real, path), "rb") as f:
                        data = f.read(max_bytes + 1)
                except OSError:
                    continue
                if len(data) <= max_bytes:
                    paths.append(path)
                    held.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(read, "path string, content binary")


def decoded(content):
    """Bytes as text; what isn't valid UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def repository_files(spark: SparkSession, root: str, *, include=("**",), exclude=(), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content, size, file_hash) of text files, ordered by path.

    The driver lists paths, sizes and times only; globs and sizes are tested on that listing,
    so files that they drop are never opened. Every listed path is confined to the root.
    """
    rows = contents(listing(spark, root, include=include, exclude=exclude, max_bytes=max_bytes), root, max_bytes)
    return text_only(rows).select("path", decoded(F.col("content")).alias("content"), F.octet_length("content").cast("long").alias("size"), content_hash(F.col("content")).alias("file_hash")).orderBy("path")


def text_only(df: DataFrame, column: str = "content") -> DataFrame:
    """Rows without a NUL among their first bytes."""
    return df.filter(~F.contains(F.substring(column, 1, PROBE), F.lit(b"\x00")))

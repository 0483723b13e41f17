"""Shared plumbing of the training-data operators.

* :func:`cut` writes a table to the shared folder named by ``spark.checkpoint.dir`` and
  reads it back, so a lost executor costs a re-read and never a recomputed lineage;
  :func:`scratch` deletes such tables once the result no longer reads them.
* :func:`map_text` runs a vectorised Arrow function over whole texts, in sub-batches whose
  size is bounded in bytes, and passes other columns through untouched.
* :func:`components` labels connected components with alternating large-star and
  small-star rounds; links never leave the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder (tests, one machine).
OWN_CHECKPOINTS = "/tmp/checkpoints"
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2048
_SCRATCH: ContextVar[tuple] = ContextVar("tables cut in the open scratch blocks", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; our own only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or OWN_CHECKPOINTS).rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if made := _SCRATCH.get():
        made[0].append(back)
    return back


@contextmanager
def scratch():
    """Tables cut inside are deleted at the end, but for those given to the yielded function."""
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._cut_path)
        return df

    outer = _SCRATCH.get()
    token = _SCRATCH.set(((made, *outer) if outer else (made,)))
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for df in made:
            if df._cut_path not in kept:
                discard(df)
            elif outer:
                outer[0].append(df)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, text: str, batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of at most batch_bytes of text and BATCH_ROWS rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > batch_bytes or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[..., list]],
    fields: list[tuple[str, str]],
    *,
    text: str = "text",
    keep: list[str] | None = None,
    args: list[str] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Append ``fields`` computed from each row's text.

    ``make()`` runs once in each task and returns ``f(texts, *args)``, which gets an Arrow
    string array (and one array for each column of ``args``) and returns one list or array
    for each field. ``keep`` names the columns that stay (all by default). A kept column
    whose name equals a new field's gives way to the new field. Batches are cut by bytes,
    so long texts don't raise the memory a task needs beyond the longest single text.
    """
    fresh = {n.lower() for n, _ in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fresh]
    args = args or []
    flat = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], *[col(c).alias(f"a{i}") for i, c in enumerate(args)], col(text).alias("t"))
    out_schema = T.StructType([*[T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(kept)], *[T.StructField(f"f{i}", T._parse_datatype_string(t)) for i, (_, t) in enumerate(fields)]])
    n_kept, n_args, kinds = len(kept), len(args), [t for _, t in fields]

    def run(batches):
        f = make()
        for whole in batches:
            for b in slices(whole, "t", batch_bytes):
                got = f(b.column("t"), *[b.column(f"a{i}") for i in range(n_args)])
                made = [x if isinstance(x, pa.Array) else pa.array(x, ARROW[k]) for x, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(f"k{i}") for i in range(n_kept)], *made], names=out_schema.names)

    out = flat.mapInArrow(run, out_schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"f{i}").alias(n) for i, (n, _) in enumerate(fields)])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node with links; root is the smallest node of its component.

    ``edges`` has two long columns, ``a`` and ``b``. Large-star and small-star rounds
    alternate until no edge changes; each round's edges are written to the shared folder.
    Sums and minima combine map-side; the only other exchange is a plain equi-join, which
    adaptive execution splits for a node with very many links.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        with_low = both.join(low, "a")
        if large:
            return with_low.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return with_low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()

    now = cut(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    state = mark(now)
    if state[0]:
        for _ in range(rounds):
            new = cut(tidy(star(tidy(star(now, True)), False)), "links")
            discard(now)
            now, before, state = new, state, mark(new)
            if state == before:
                break
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

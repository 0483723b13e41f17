"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(1024 x). Each task lays its candidates out vertically, one
array for each dimension, and for each query accumulates inner products one block of
dimensions after another. After a block, what the remaining dimensions can still add is at
most |q_rest| |x_rest| (Cauchy-Schwarz); candidates whose sum plus that bound stays below the
query's threshold are compacted away. The threshold is the k-th best exact score over a
bounded sample of candidates, raised by each block of candidates that the task has seen, so
nothing that could enter the top k, ties included, is dropped.

Queries form a stated set and meet all candidates in blocks: query blocks of at most
``QUERY_BLOCK`` vectors are sent to the tasks one after another, each in a pass of its own
over the candidates. Each task keeps k rows a query; those are merged by a second top-k.

Defined cases: null vectors, and vectors holding null, NaN or infinite components, take no
part; a query meets candidates of its own dimension; rows that share the query's vec_id are
its own row, and a repeated query id is searched once, by its least vector; ties go to the smaller vec_id; other repeated rows count each; a query with
fewer than k candidates gets them all; a null vec_id takes no part; an empty table gives an
empty result. Sums are exact up to 2**53 in floating point, beyond that in Python integers,
and results outside the long range are held at its ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, cut

QUERY_BLOCK = 2048
SAMPLE = 2048
DIM_BLOCK = 16
CANDIDATES = 8192
SCALE = 1024
LONG = (-(2**63), 2**63 - 1)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as floats where that is exact enough, else as Python integers."""
    y = np.floor(x * SCALE) if np.abs(x).max(initial=0) < 2.0**40 else None
    if y is not None and np.abs(y).max(initial=0) ** 2 * x.shape[1] < 2.0**53:
        return y
    return np.array([[int(v * SCALE // 1) if abs(v) < 2.0**900 else int(v) * SCALE for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.dtype == object or x.dtype == object or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(q)) >= 2.0**53:
        return np.array([sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in x], dtype=object)
    return x @ q


def _rest_norms(v: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    """Upper bounds of the norms of what lies beyond each edge; v has a row a vector."""
    squares = v.astype(np.float64) ** 2
    return [np.sqrt(squares[:, e:].sum(axis=1)) * (1 + 1e-9) for e in edges]


def best_of(scores, ids, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to the smaller id."""
    if len(scores) > 4 * k and getattr(scores, "dtype", None) != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        scores, ids = scores[some], ids[some]
    return sorted(zip((int(s) for s in scores), (int(i) for i in ids), strict=True), key=lambda t: (-t[0], t[1]))[:k]


def search_block(queries, thresholds, ids: np.ndarray, x: np.ndarray, found: list, k: int) -> None:
    """Put the candidates (ids, x) that may be among a query's best into ``found``."""
    dims = x.shape[1]
    edges = list(range(DIM_BLOCK, dims, DIM_BLOCK)) + [dims]
    if x.dtype == object:
        for n, (qid, q, _) in enumerate(queries):
            own = ids != qid
            found[n] = _merge(found[n], best_of(_scores(q, x[own]), ids[own], k), k)
        return
    columns = np.ascontiguousarray(x.T)
    rest = _rest_norms(x, edges)
    for n, (qid, q, q_rest) in enumerate(queries):
        if q.dtype == object or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, dims) >= 2.0**53:
            own = ids != qid
            found[n] = _merge(found[n], best_of(_scores(q, x[own]), ids[own], k), k)
            continue
        alive, sums, start = None, np.zeros(len(ids)), 0
        floor = thresholds[n]
        for b, edge in enumerate(edges):
            if alive is None:
                sums = sums + q[start:edge] @ columns[start:edge]
            else:
                sums = sums + q[start:edge] @ columns[start:edge, alive]
            start = edge
            if edge < dims and floor is not None:
                bound = rest[b] if alive is None else rest[b][alive]
                stay = np.flatnonzero(sums + q_rest[b] * bound >= floor)
                if len(stay) < 0.7 * len(sums):
                    alive = stay if alive is None else alive[stay]
                    sums = sums[stay]
        kept = np.arange(len(ids)) if alive is None else alive
        own = ids[kept] != qid
        if floor is not None:
            own &= sums >= floor
        if own.any():
            found[n] = _merge(found[n], best_of(sums[own], ids[kept][own], k), k)
            if len(found[n]) == k:
                thresholds[n] = max(found[n][-1][0], floor) if floor is not None else found[n][-1][0]


def _merge(a: list, b: list, k: int) -> list:
    return sorted([*a, *b], key=lambda t: (-t[0], t[1]))[:k] if a else b


def _prepared(rows: list[tuple[int, np.ndarray]]) -> list[tuple]:
    out = []
    for qid, q in rows:
        edges = list(range(DIM_BLOCK, len(q), DIM_BLOCK)) + [len(q)]
        out.append((qid, q, [float(r[0]) for r in _rest_norms(q.reshape(1, -1), edges)] if q.dtype != object else None))
    return out


def _whole_rows(rows) -> list[tuple[int, np.ndarray]]:
    return [(r[0], _whole(np.array([r[1]], dtype=np.float64))[0] if r[1] else np.zeros(0)) for r in rows]


def top_k(vectors: DataFrame, is_query, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates."""
    spark = vectors.sparkSession
    v = F.col("v")
    usable = vectors.select(col(id_col).cast("long").alias("i"), col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("i").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )
    queries = usable.filter(is_query(F.col("i"))).groupBy("i").agg(F.min("v").alias("v"))
    n_queries, n_all = queries.count(), usable.count()
    n_blocks = max(1, -(-n_queries // query_block))
    # A bounded sample of candidates gives each query a threshold to begin with.
    part = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1_000_003))
    sample = _whole_rows(usable.filter(part <= int(1_000_003 * min(1.0, SAMPLE / max(1, n_all)))).limit(2 * SAMPLE).collect())
    done = []
    for b in range(n_blocks):
        some = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("i", "v"), F.lit(n_blocks)) == b)
        rows = _prepared(_whole_rows(some.collect()))
        by_dim: dict[int, list] = {}
        for q in rows:
            by_dim.setdefault(len(q[1]), []).append(q)
        blocks = {}
        for dim, qs in by_dim.items():
            held = [(i, x) for i, x in sample if len(x) == dim and x.dtype != object]
            ids, x = np.array([i for i, _ in held], dtype=np.int64), np.array([x for _, x in held]).reshape(len(held), dim)
            floors = []
            for qid, q, _ in qs:
                own = ids != qid
                best = best_of(_scores(q, x[own]), ids[own], k) if dim and held else []
                floors.append(best[-1][0] if len(best) == k else None)
            blocks[dim] = (qs, floors)
        done.append(cut(_pass(spark, usable, blocks, k), "topk"))
    # One scan of all passes' folders, however many there are.
    merged = spark.read.schema(done[0].schema).parquet(*[d._cut_path for d in done])
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id", "copy")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(spark, usable: DataFrame, blocks: dict, k: int) -> DataFrame:
    held = spark.sparkContext.broadcast(blocks)

    def run(batches):
        import pyarrow as pa

        blocks = held.value
        floors = {d: list(f) for d, (_, f) in blocks.items()}
        found = {d: [[] for _ in qs] for d, (qs, _) in blocks.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                b = batch.slice(at, CANDIDATES)
                ids, vectors = b.column("i").to_numpy(), b.column("v")
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for dim in blocks:
                    rows = np.flatnonzero(sizes == dim)
                    if not len(rows):
                        continue
                    x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)[None]] if dim else np.zeros((len(rows), 0))
                    search_block(blocks[dim][0], floors[dim], ids[rows], _whole(x), found[dim], k)
        out = [(qs[n][0], i, s, c) for d, (qs, _) in blocks.items() for n, best in enumerate(found[d]) for c, (s, i) in enumerate(best)]
        held_in = [min(max(s, LONG[0]), LONG[1]) for _, _, s, _ in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array(held_in, pa.int64()), pa.array([float(max(min(o[2], 10**300), -(10**300))) if abs(o[2]) > 2**62 else float(0) for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int32())],
            names=["query_id", "vec_id", "score", "beyond", "copy"],
        )

    got = usable.mapInArrow(run, "query_id long, vec_id long, score long, beyond double, copy int")
    return got.select("query_id", "vec_id", "score", F.struct("beyond", "score").alias("exact"), "copy")

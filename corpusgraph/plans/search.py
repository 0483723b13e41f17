"""Hybrid retrieval as one plan: seeds, fusion, graph spread, multipliers, final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.graph import spread
from corpusgraph.operators.ranking import fuse, multiplied, ranks, recency
from corpusgraph.plans.lineage import held
from corpusgraph.schema import EXACT_LIMIT, LEXICAL_LIMIT, SEEDS, SEMANTIC_LIMIT, SPREAD_LIMIT

#: More rows than the sources of seeds give together.
SEED_ROWS = 4 * (EXACT_LIMIT + LEXICAL_LIMIT + SEMANTIC_LIMIT)


def hybrid(seeds: list[DataFrame], edges: DataFrame, nodes: DataFrame, as_of, *, hops: int = 2) -> DataFrame:
    """(id, score, via) over ``nodes`` (id, updated_at, pinned, state, allowed).

    ``seeds`` are (source, id, rank) DataFrames behind top-k limits, so everything from here
    on is bounded by the limits; the edges meet the frontier in equi-joins.
    """
    ranked = seeds[0]
    for s in seeds[1:]:
        ranked = ranked.unionByName(s)
    ok = nodes.filter("allowed").select("id")
    # Seeds and what a spread reaches are a few hundred rows behind their limits.
    ranked = held(ranked.join(ok, "id", "left_semi"), SEED_ROWS)
    first = fuse(ranked)
    start = first.orderBy(F.desc("score"), "id").limit(SEEDS).select("id", "score")
    reached = held(spread(edges, start, hops, allowed=ok), SPREAD_LIMIT)
    structural = ranks(reached).select(F.lit("structural").alias("source"), "id", "rank")
    total = fuse(ranked.select("source", "id", "rank").unionByName(structural))
    joined = total.join(nodes.select("id", "updated_at", "pinned", "state"), "id")
    score = multiplied(recency(F.col("score"), F.col("updated_at"), (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")), F.col("pinned"), F.col("state"))
    return joined.select("id", score.alias("score"), "via").orderBy(F.desc("score"), "id")

"""Traversals: neighbours, reverse-dependency impact and bounded best-score spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.lineage import written
from corpusgraph.schema import IMPACT_LIMIT, NEIGHBOR_LIMIT, SPREAD_EDGES, SPREAD_LIMIT


def neighbors(edges: DataFrame, node: str, kinds: list[str] | None = None, reverse: bool = False, limit: int = NEIGHBOR_LIMIT) -> DataFrame:
    """(id, kind, weight), heaviest first. The filter on one end reaches the scan."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    rows = edges.filter(F.col(here) == node)
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    return rows.select(F.col(there).alias("id"), "kind", "weight").orderBy(F.desc("weight"), "id").limit(limit)


def impact_edges(edges: DataFrame) -> DataFrame:
    """Steps of the impact walk: calls and imports backwards, tests forwards."""
    back = edges.filter(F.col("kind").isin("calls", "imports")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    return back.unionByName(edges.filter("kind = 'tested_by'").select("src", "dst", "kind"))


def reach(steps: DataFrame, start: str, depth: int, limit: int | None = IMPACT_LIMIT) -> DataFrame:
    """(id, hops, path) by level-synchronous search; one join and one anti-join a level."""
    if not 0 <= depth <= 8:
        raise ValueError("depth must be between 0 and 8")
    spark = steps.sparkSession
    seen = spark.createDataFrame([(start, 0, [])], "id string, hops int, path array<string>")
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), F.array_append("path", F.col("dst")).alias("path"))
        # The first-discovered path is the least one, so that results don't depend on order.
        found = found.groupBy("id").agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
        frontier = written(found.join(seen.select("id"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if limit and seen.count() > limit:
            # Nearer nodes come first, so what lies beyond these can't be among the results.
            break
    out = seen.filter(F.col("id") != start)
    return out.orderBy("hops", "id").limit(limit) if limit else out


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.6, floor: float = 0.001, limit: int = SPREAD_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score): best product of seed score, weights and decay over at most ``hops`` edges.

    With ``allowed`` (distinct ids) no path leads through others; the few nodes that a hop reaches
    are looked up there, not the ends of all edges.
    """
    if not 0 <= hops <= 4:
        raise ValueError("hops must be between 0 and 4")
    live = edges.filter(F.col("kind").isin(*SPREAD_EDGES))
    both = live.select("src", "dst", "weight").union(live.select(F.col("dst"), F.col("src"), "weight"))
    best = seeds.select("id", "score")
    frontier = best
    for hop in range(hops):
        if hop:
            # Scores only fall along a path: what is below the results found already leads to none.
            top = best.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score")).limit(limit).agg(F.count(F.lit(1)), F.min("score")).first()
            frontier = frontier.filter(F.col("score") >= top[1]) if top[0] == limit else frontier
        step = frontier.join(both, frontier["id"] == both["src"]).select(F.col("dst").alias("id"), (F.col("score") * F.col("weight") * decay).alias("score"))
        reached = step.filter(F.col("score") >= floor).groupBy("id").agg(F.max("score").alias("score"))
        frontier = written(reached if allowed is None else reached.join(allowed.select("id"), "id"), "spread")
        best = best.unionByName(frontier)
    return best.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def resolve(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, n_matches): by id, then file path, then qualified name, then name."""
    tiers = None
    for tier, key in enumerate(("id", "path", "qualname", "name")):
        rows = nodes.filter(F.col("kind") == "file") if key == "path" else nodes
        hit = targets.join(rows.select(F.col(key).alias("target"), F.col("id").alias("node")).filter(F.col("target").isNotNull()), "target").select("target", "node", F.lit(tier).alias("tier"))
        tiers = hit if tiers is None else tiers.unionByName(hit)
    first = tiers.withColumn("best", F.min("tier").over(Window.partitionBy("target"))).filter("tier = best")
    return first.groupBy("target").agg(F.min("node").alias("id"), F.min("tier").alias("tier"), F.countDistinct("node").alias("n_matches"))


def callers_and_callees(edges: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(id, callees, callers): sorted distinct names, at most twelve of each."""
    calls = edges.filter("kind = 'calls'")
    out = calls.join(names.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("ns")).select("id", F.array_join(F.slice("ns", 1, most), ",").alias("callees"))
    into = calls.join(names.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("ns")).select("id", F.array_join(F.slice("ns", 1, most), ",").alias("callers"))
    return out.join(into, "id", "full_outer")

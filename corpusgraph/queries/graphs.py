"""Graph queries over the star schema in its graph role."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.queries.registry import EDGES_SQL, NODES_SQL, query, star_edges, star_nodes, table


@query("neighbors_fwd", f"WITH {EDGES_SQL} SELECT dst AS id, kind, weight FROM edges WHERE src = 'r1' AND kind IN ('defines') ORDER BY weight DESC, id LIMIT 80")
def neighbors_fwd(spark, d):
    return graph.neighbors(star_edges(spark, d), "r1", ["defines"])


@query("neighbors_rev", f"WITH {EDGES_SQL} SELECT src AS id, kind, weight FROM edges WHERE dst = 'n3' ORDER BY weight DESC, id LIMIT 80")
def neighbors_rev(spark, d):
    return graph.neighbors(star_edges(spark, d), "n3", reverse=True)


WALK_SQL = f"""
WITH RECURSIVE {EDGES_SQL},
steps AS (SELECT dst AS a, src AS b FROM edges WHERE kind IN ('calls', 'imports') UNION ALL SELECT src, dst FROM edges WHERE kind = 'tested_by'),
walk(id, hops) AS (SELECT 'n3', 0 UNION SELECT b, hops + 1 FROM walk JOIN steps ON a = id WHERE hops < 3)"""


def walked(spark, d, limit=None):
    return graph.reach(graph.impact_edges(star_edges(spark, d)), "n3", 3, limit)


@query("impact_bfs", WALK_SQL + " SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE id <> 'n3' GROUP BY id")
def impact_bfs(spark, d):
    return walked(spark, d).select("id", "hops")


@query("impact_limited", WALK_SQL + " SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE id <> 'n3' GROUP BY id ORDER BY 2, 1 LIMIT 200")
def impact_limited(spark, d):
    return walked(spark, d, graph.IMPACT_LIMIT).select("id", "hops")


@query("impact_tests_only", WALK_SQL + " SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE starts_with(id, 'c') GROUP BY id")
def impact_tests_only(spark, d):
    tests = star_nodes(spark, d).filter("kind = 'test'").select("id")
    return walked(spark, d).join(tests, "id", "left_semi").select("id", "hops")


@query("impact_recursive_cte", WALK_SQL + " SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY id")
def impact_recursive_cte(spark, d):
    steps = graph.impact_edges(star_edges(spark, d)).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    # The view is needed for analysis only; its name is this call's own.
    name = f"impact_steps_{uuid.uuid4().hex}"
    steps.createTempView(name)
    walk = spark.sql(
        f"""WITH RECURSIVE walk(id, hops, path) AS (
          SELECT 'n3', 0, array('n3')
          UNION ALL SELECT b, hops + 1, array_append(path, b) FROM walk JOIN {name} ON a = id WHERE hops < 3 AND NOT array_contains(path, b)
        ) SELECT id, min(hops) AS hops FROM walk GROUP BY id"""
    )
    spark.catalog.dropTempView(name)
    return walk


SPREAD_SQL = f"""
WITH {EDGES_SQL},
both_ways AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
s0 AS (SELECT * FROM (VALUES ('n3', CAST(1.0 AS DOUBLE)), ('r1', CAST(0.5 AS DOUBLE))) v(id, score)),
s1 AS (SELECT b AS id, max(score * weight * 0.6) AS score FROM s0 JOIN both_ways ON a = id WHERE score * weight * 0.6 >= 0.001 GROUP BY b),
s2 AS (SELECT b AS id, max(score * weight * 0.6) AS score FROM s1 JOIN both_ways ON a = id WHERE score * weight * 0.6 >= 0.001 GROUP BY b),
al AS (SELECT id, round(max(score), 9) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id)
SELECT id, score FROM al ORDER BY score DESC, id LIMIT 80"""


@query("spread_2hop", SPREAD_SQL)
def spread_2hop(spark, d):
    seeds = spark.createDataFrame([("n3", 1.0), ("r1", 0.5)], "id string, score double")
    return graph.spread(star_edges(spark, d), seeds).select("id", F.round("score", 9).alias("score"))


@query(
    "callers_callees",
    f"WITH {EDGES_SQL}, {NODES_SQL}, o AS (SELECT src AS id, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 12), ',') AS callees FROM edges JOIN nodes ON dst = id WHERE edges.kind = 'calls' GROUP BY src), i AS (SELECT dst AS id, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 12), ',') AS callers FROM edges JOIN nodes ON src = id WHERE edges.kind = 'calls' GROUP BY dst) SELECT id, callees, callers FROM o FULL JOIN i USING (id)",
)
def callers_callees(spark, d):
    return graph.callers_and_callees(star_edges(spark, d), star_nodes(spark, d).select("id", "name"))


@query(
    "resolve_tiered",
    f"WITH {NODES_SQL}, t AS (SELECT unnest(['r1', 'ASIA', 'Customer#000000001', 'n3', 'EUROPE', 'NATION_3', 'nothing']) AS target) SELECT target, id, tier, n_matches FROM (SELECT t.target, n.id, 0 AS tier, 1 AS n_matches FROM t JOIN nodes n ON n.id = t.target UNION ALL SELECT t.target, min(n.id), 3, count(DISTINCT n.id) FROM t JOIN nodes n ON n.name = t.target WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.id = t.target) GROUP BY t.target)",
)
def resolve_tiered(spark, d):
    names = ["r1", "ASIA", "Customer#000000001", "n3", "EUROPE", "NATION_3", "nothing"]
    nodes = star_nodes(spark, d).withColumns({"path": F.lit(None).cast("string"), "qualname": F.lit(None).cast("string")})
    return graph.resolve(nodes, spark.createDataFrame([(n,) for n in names], "target string")).select("target", "id", "tier", "n_matches")


@query("seed_exact", "SELECT c_custkey AS id, 'exact' AS source, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30")
def seed_exact(spark, d):
    from corpusgraph.operators.ranking import ranks

    hits = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("score"))
    return ranks(hits, limit=30).select("id", F.lit("exact").alias("source"), "rank")

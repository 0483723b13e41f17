"""Edge derivation, drift between snapshots, upserts and other joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import content_hash, tokens
from corpusgraph.operators import drift, edges
from corpusgraph.operators.memory import pinned_first
from corpusgraph.queries.registry import PATH_SQL, TOKENS_SQL, doc_files, query, table

# Call sites are a document's tokens, definitions a benchmark item's.
CALLS_SQL = f"""
sites AS (SELECT DISTINCT 'd' || doc_id AS caller, unnest({TOKENS_SQL.format('text')}) AS callee FROM documents),
defs AS (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS name, 'b' || item_id AS id FROM benchmark),
fan AS (SELECT name, count(*) AS fan FROM defs GROUP BY name)"""


def sites_and_defs(spark, d):
    sites = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("caller"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("callee"))
    defs = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("name"), F.concat(F.lit("b"), F.col("item_id")).alias("id"))
    return sites, defs


@query("edge_defines", f"SELECT DISTINCT 'f' || item_id AS src, unnest({TOKENS_SQL.format('text')}) AS dst, 'defines' AS kind, CAST(0.9 AS DOUBLE) AS weight FROM benchmark")
def edge_defines(spark, d):
    symbols = table(spark, d, "benchmark").select(F.concat(F.lit("f"), F.col("item_id")).alias("file_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("id"))
    return edges.defines(symbols)


@query(
    "edge_calls_fanout",
    f"WITH {CALLS_SQL} SELECT caller AS src, id AS dst, 'calls' AS kind, CAST(max(CASE WHEN fan > 1 THEN 0.4 ELSE 0.8 END) AS DOUBLE) AS weight FROM sites JOIN defs ON callee = name JOIN fan USING (name) WHERE fan <= 8 AND caller <> id GROUP BY 1, 2",
)
def edge_calls_fanout(spark, d):
    return edges.calls(*sites_and_defs(spark, d))


@query(
    "edge_tested_by",
    """
WITH c AS (SELECT DISTINCT event_id AS id, 'test_' || event_type || '_' || (user_id % 40) AS name FROM events),
s AS (SELECT 's' || u AS id, t || '_' || u AS name FROM (SELECT DISTINCT event_type AS t, user_id % 40 AS u FROM events)),
fan AS (SELECT name, count(DISTINCT id) AS fan FROM s GROUP BY name)
SELECT DISTINCT s.id || '/' || s.name AS src, 't' || c.id AS dst, 'tested_by' AS kind, CAST(0.85 AS DOUBLE) AS weight FROM c JOIN s ON regexp_replace(c.name, '^(?:test_|Test|test)', '') = s.name JOIN fan ON fan.name = s.name WHERE fan <= 8""",
)
def edge_tested_by(spark, d):
    ev = table(spark, d, "events").withColumn("u", F.col("user_id") % 40)
    tests = ev.select(F.concat(F.lit("t"), F.col("event_id")).alias("id"), F.concat(F.lit("test_"), "event_type", F.lit("_"), "u").alias("name"))
    name = F.concat("event_type", F.lit("_"), "u")
    subjects = ev.select(F.concat(F.lit("s"), "u", F.lit("/"), name).alias("id"), name.alias("name")).distinct()
    return edges.tested_by(tests, subjects)


IMPORTS_SQL = """
WITH links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS c FROM pages),
files AS (SELECT 'p/' || page_id || '/' || regexp_extract(html, 'href="/([^"/]+)"', 1) AS path FROM pages WHERE contains(url, '://www.')),
tails AS (SELECT path, regexp_replace(path, '^p/[0-9]+/', '') AS c FROM files),
found AS (SELECT 'p/' || l.page_id AS src, l.c, count(DISTINCT t.path) AS n, min(t.path) AS dst FROM links l JOIN tails t ON l.c = t.c AND NOT starts_with(t.path, 'p/' || l.page_id || '/') GROUP BY 1, 2)
SELECT DISTINCT src, dst, 'imports' AS kind, CAST(0.6 AS DOUBLE) AS weight FROM found WHERE n = 1"""


@query("edge_imports_unique", IMPORTS_SQL)
def edge_imports_unique(spark, d):
    # A page imports what its links name; pages of www hosts are files, whose path ends in the
    # name of their first link.
    links = F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), 1)
    pages = table(spark, d, "pages").select(F.concat(F.lit("p/"), F.col("page_id")).alias("src_path"), F.array_distinct(links).alias("links"), F.element_at(links, 1).alias("own"), "url")
    statements = pages.select("src_path", F.explode("links").alias("c")).select("src_path", F.col("c").alias("statement_id"), F.lit(True).alias("by_suffix"), F.array("c").alias("candidates"))
    # A page is its own file's source under the file's name, so that it never imports itself.
    is_file = F.contains("url", F.lit("://www."))
    pages = pages.withColumn("as_file", F.when(is_file, F.concat("src_path", F.lit("/"), "own")).otherwise(F.col("src_path")))
    statements = statements.join(pages.select("src_path", "as_file"), "src_path").select(F.col("as_file").alias("src_path"), "statement_id", "by_suffix", "candidates")
    files = pages.filter(is_file).select(F.concat("src_path", F.lit("/"), "own").alias("path"))
    return edges.imports(statements, files).withColumn("src", F.regexp_extract("src", "^p/[0-9]+", 0))


SPANS_SQL = """
WITH o AS (SELECT user_id, event_id, ts, lag(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
spans AS (SELECT user_id, event_id AS span_id, epoch_us(s) AS "start", epoch_us(ts) AS "end" FROM o WHERE s IS NOT NULL),
points AS (SELECT DISTINCT user_id, epoch_us(ts) AS "at" FROM events),
j AS (SELECT p.user_id, p."at", s.span_id, s."end" - s."start" AS width FROM points p JOIN spans s ON p.user_id = s.user_id AND s."start" <= p."at" AND p."at" <= s."end")"""


def spans_and_points(spark, d):
    ev = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = ev.withColumn("start", F.lag("us", 3).over(w)).filter("start is not null").select("user_id", F.col("event_id").alias("span_id"), "start", F.col("us").alias("end"))
    return spans, ev.select("user_id", F.col("us").alias("at")).distinct()


@query("interval_join_narrowest", SPANS_SQL + ''' SELECT user_id, "at", arg_min(span_id, {'w': width, 's': span_id}) AS span_id, min(width) AS width FROM j GROUP BY user_id, "at"''')
def interval_join_narrowest(spark, d):
    spans, points = spans_and_points(spark, d)
    return edges.narrowest_cover(points, spans, "user_id")


@query("join_range", SPANS_SQL + ''' SELECT user_id, "at", count(*) AS n FROM j GROUP BY user_id, "at"''')
def join_range(spark, d):
    spans, points = spans_and_points(spark, d)
    return edges.covers(points, spans, "user_id").groupBy("user_id", "at").agg(F.count(F.lit(1)).alias("n"))


@query("join_asof", "SELECT e.event_id, p.event_id AS prior_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(spark, d):
    # One sort: the rows to look up and those to look among are the same partition's.
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    prior = F.when(F.col("event_type") == "purchase", F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i")))
    return table(spark, d, "events").withColumn("p", prior).select("event_id", F.max("p").over(w)["i"].alias("prior_id"))


CHANGES_SQL = """
ch AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem),
ok AS (SELECT c FROM ch GROUP BY c HAVING count(*) <= 20),
r AS (SELECT ch.* FROM ch JOIN ok USING (c)),
n AS (SELECT s, count(*) AS n FROM r GROUP BY s),
pc AS (SELECT x.s AS a, y.s AS b, count(*) AS commits FROM r x JOIN r y ON x.c = y.c AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 2)"""
SUPPORT = 0.05


@query("cochange_pairs", f"WITH {CHANGES_SQL} SELECT a, b, commits, round(commits / CAST(greatest(x.n, y.n) AS DOUBLE), 3) AS support FROM pc JOIN n x ON x.s = a JOIN n y ON y.s = b WHERE commits / CAST(greatest(x.n, y.n) AS DOUBLE) >= {SUPPORT}")
def cochange_pairs(spark, d):
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("symbol"))
    return edges.changed_together(changes, support=SUPPORT).withColumn("support", F.round("support", 3))


# The greedy fold itself: pairs in their order, each kept while both ends have room.
CAPPED_SQL = f"""
WITH RECURSIVE {CHANGES_SQL},
rated AS (SELECT a, b, commits, commits / CAST(greatest(x.n, y.n) AS DOUBLE) AS support FROM pc JOIN n x ON x.s = a JOIN n y ON y.s = b WHERE commits / CAST(greatest(x.n, y.n) AS DOUBLE) >= {SUPPORT}),
ordered AS (SELECT *, row_number() OVER (ORDER BY commits DESC, a, b) AS k FROM rated),
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ends, false AS kept
  UNION ALL
  SELECT o.k, CASE WHEN ok THEN f.ends || [o.a, o.b] ELSE f.ends END, ok
  FROM fold f JOIN (SELECT * FROM ordered) o ON o.k = f.k + 1,
  LATERAL (SELECT len(list_filter(f.ends, lambda x: x = o.a)) < 8 AND len(list_filter(f.ends, lambda x: x = o.b)) < 8 AS ok)
)
SELECT a, b, commits, round(support, 3) AS support FROM ordered JOIN fold USING (k) WHERE kept"""


@query("cochange_capped", CAPPED_SQL)
def cochange_capped(spark, d):
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("symbol"))
    return edges.capped_degree(edges.changed_together(changes, support=SUPPORT)).withColumn("support", F.round("support", 3))


# An older and a newer snapshot of the documents, by fixed rules.
OLD_SQL = f"old AS (SELECT doc_id, {PATH_SQL} AS path, 'sha256:' || sha256(text) AS file_hash FROM documents)"
NEW_SQL = f"new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'moved/' || doc_id ELSE {PATH_SQL} END AS path, 'sha256:' || sha256(CASE WHEN doc_id % 5 = 1 THEN text || ' edited' ELSE text END) AS file_hash FROM documents WHERE doc_id % 11 <> 4)"
SNAP_SQL = f"WITH {OLD_SQL}, {NEW_SQL} "


def snapshots(spark, d):
    docs = doc_files(spark, d)
    old = docs.select("doc_id", "path", content_hash(F.col("content")).alias("file_hash"))
    path = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("moved/"), F.col("doc_id"))).otherwise(F.col("path"))
    content = F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    new = docs.filter("doc_id % 11 <> 4").select("doc_id", path.alias("path"), content_hash(content).alias("file_hash"))
    return old, new


@query("incremental_semi", SNAP_SQL + "SELECT doc_id FROM new WHERE EXISTS (SELECT 1 FROM old WHERE old.path = new.path AND old.file_hash = new.file_hash)")
def incremental_semi(spark, d):
    old, new = snapshots(spark, d)
    return drift.unchanged(new, old).select("doc_id")


@query("incremental_changed", SNAP_SQL + "SELECT doc_id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = new.path AND old.file_hash = new.file_hash)")
def incremental_changed(spark, d):
    old, new = snapshots(spark, d)
    return drift.changed(new, old).select("doc_id")


@query("removed_anti", SNAP_SQL + "SELECT path FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE old.path = new.path)")
def removed_anti(spark, d):
    old, new = snapshots(spark, d)
    return drift.removed(new, old).select("path")


MOVES_SQL = """
o1 AS (SELECT file_hash, min(path) AS old_path FROM old GROUP BY 1 HAVING count(*) = 1),
w1 AS (SELECT file_hash, min(path) AS new_path FROM new GROUP BY 1 HAVING count(*) = 1),
moves AS (SELECT old_path, new_path FROM o1 JOIN w1 USING (file_hash) WHERE old_path <> new_path AND NOT EXISTS (SELECT 1 FROM new WHERE path = old_path))"""


def moves_of(spark, d):
    old, new = snapshots(spark, d)
    at = lambda df: df.select("path", F.lit(None).cast("string").alias("symbol"), F.col("file_hash").alias("body_hash"))
    return drift.renames(at(old), at(new)), old, new


@query("rename_unique_match", SNAP_SQL + f", {MOVES_SQL} SELECT old_path, new_path FROM moves")
def rename_unique_match(spark, d):
    return moves_of(spark, d)[0].select("old_path", "new_path")


ANCHORS_SQL = f", {MOVES_SQL}, mem AS (SELECT 'm' || doc_id AS id, path, file_hash AS span_hash FROM old WHERE doc_id % 2 = 0), anchored AS (SELECT id, coalesce(new_path, path) AS path, span_hash, CASE WHEN new_path IS NOT NULL THEN path END AS moved_from FROM mem LEFT JOIN moves ON old_path = path)"


def anchored(spark, d):
    moves, old, new = moves_of(spark, d)
    nothing = F.lit(None).cast("string")
    memories = old.filter("doc_id % 2 = 0").select(F.concat(F.lit("m"), F.col("doc_id")).alias("id"), "path", nothing.alias("symbol"), F.col("file_hash").alias("span_hash"), nothing.alias("moved_from"))
    return drift.move_anchors(memories, moves), new


@query("anchor_move_update", SNAP_SQL + ANCHORS_SQL + " SELECT id, path, moved_from FROM anchored")
def anchor_move_update(spark, d):
    return anchored(spark, d)[0].select("id", "path", "moved_from")


LIVE_SQL = ", live AS (SELECT id, CASE WHEN a.moved_from IS NULL AND n.file_hash = a.span_hash THEN 'fresh' ELSE 'stale' END AS live FROM anchored a LEFT JOIN new n ON n.path = a.path)"


def live(spark, d):
    memories, new = anchored(spark, d)
    current = new.select("path", F.lit(None).cast("string").alias("symbol"), F.col("file_hash").alias("span_hash"))
    return drift.live_state(memories.withColumn("state", F.lit("fresh")), current)


@query("stale_left_join", SNAP_SQL + ANCHORS_SQL + LIVE_SQL + " SELECT id, live FROM live")
def stale_left_join(spark, d):
    return live(spark, d).select("id", "live")


@query("drift_rate", SNAP_SQL + ANCHORS_SQL + LIVE_SQL + " SELECT count(*) AS checked, count(*) FILTER (live = 'fresh') AS fresh, count(*) FILTER (live <> 'fresh') AS drifted, round(100.0 * count(*) FILTER (live <> 'fresh') / count(*), 2) AS drift_rate_pct FROM live")
def drift_rate(spark, d):
    return drift.drift_rate(live(spark, d))


@query("upsert_latest_wins", SNAP_SQL + "SELECT path, coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(o.doc_id, n.doc_id) AS created_at FROM old o FULL JOIN new n USING (path)")
def upsert_latest_wins(spark, d):
    old, new = snapshots(spark, d)
    return drift.upsert(old.select("path", "file_hash", F.col("doc_id").alias("created_at")), new.select("path", "file_hash", F.col("doc_id").alias("created_at")), ["path"])


@query("cascade_anti", "WITH gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 5) SELECT l_orderkey AS src, l_suppkey AS dst, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM gone) AND l_orderkey NOT IN (SELECT id FROM gone)")
def cascade_anti(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return drift.cascade(rows, table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("id")))


@query("last_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_per_key(spark, d):
    return drift.last_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("pinned_union", "WITH p AS (SELECT conv_id AS id, row_number() OVER (ORDER BY conv_id) AS rank FROM conversations WHERE turn = 0 AND conv_id % 10 = 0), f AS (SELECT conv_id AS id, row_number() OVER (ORDER BY conv_id DESC) AS rank FROM conversations WHERE turn = 0 AND conv_id % 2 = 0) SELECT id, 0 AS tier, rank FROM p UNION ALL SELECT id, 1, rank FROM f WHERE id NOT IN (SELECT id FROM p)")
def pinned_union(spark, d):
    first = table(spark, d, "conversations").filter("turn = 0")
    number = lambda df, order: df.select(F.col("conv_id").alias("id"), F.row_number().over(Window.orderBy(order)).alias("rank"))
    return pinned_first(number(first.filter("conv_id % 10 = 0"), F.asc("conv_id")), number(first.filter("conv_id % 2 = 0"), F.desc("conv_id")))


@query("join_left_outer", "SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left_outer(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_lines"))


@query("join_full_outer", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) SELECT coalesce(c.k, s.k) AS k, n_customers, n_suppliers FROM c FULL JOIN s ON c.k = s.k")
def join_full_outer(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, d, "supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, "k", "full_outer")

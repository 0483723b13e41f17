"""Derived edges: definitions, calls, tests, imports, changes made together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.schema import AMBIGUOUS_CALL_WEIGHT, EDGE_WEIGHTS, MAX_FANOUT


def defines(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("kind"), F.lit(EDGE_WEIGHTS["defines"]).alias("weight"))


def calls(call_sites: DataFrame, definitions: DataFrame, most: int = MAX_FANOUT) -> DataFrame:
    """Calls joined to definitions by name; names with more than ``most`` targets are dropped.

    The fan-out is counted before the join, so frequent names never reach it, and call sites meet
    the names that are left before they are told apart: the aggregate behind the join does that.
    """
    # Nulls go here, so that both uses of the names are one subplan, whose exchange is reused.
    names = definitions.select("name", "id").filter("name is not null and id is not null").distinct()
    fan = names.groupBy("name").agg(F.count(F.lit(1)).alias("fan")).filter(F.col("fan") <= most)
    targets = names.join(fan, "name")
    weight = F.when(F.col("fan") > 1, AMBIGUOUS_CALL_WEIGHT).otherwise(EDGE_WEIGHTS["calls"])
    return (
        call_sites.select("caller", "callee").join(targets, F.col("callee") == F.col("name"))
        .filter(F.col("caller") != F.col("id"))
        .groupBy(F.col("caller").alias("src"), F.col("id").alias("dst"))
        .agg(F.max(weight).alias("weight"))
        .withColumn("kind", F.lit("calls"))
    )


def subject_names(test_name) -> F.Column:
    """What a test's name may be about: its stem, with and without a leading underscore."""
    stem = F.regexp_replace(test_name, "^(?:test_|Test|test)", "")
    return F.array_distinct(F.array(stem, F.regexp_replace(stem, "^_+", "")))


def tested_by(tests: DataFrame, subjects: DataFrame, most: int = MAX_FANOUT) -> DataFrame:
    wanted = tests.select(F.col("id").alias("test"), F.explode(subject_names(F.col("name"))).alias("name")).filter("name <> ''").distinct()
    names = subjects.select("name", "id").distinct()
    fan = names.groupBy("name").agg(F.count(F.lit(1)).alias("fan")).filter(F.col("fan") <= most)
    return wanted.join(names.join(fan, "name"), "name").filter("test <> id").select(F.col("id").alias("src"), F.col("test").alias("dst"), F.lit("tested_by").alias("kind"), F.lit(EDGE_WEIGHTS["tested_by"]).alias("weight")).distinct()


def path_suffixes(path) -> F.Column:
    """The path and every part of it behind a slash: turns an ends-with join into an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def imports(statements: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges: exact candidates first, suffixes for what stays open, unique targets only.

    ``statements`` has src_path, statement_id, candidates (array of paths) and by_suffix;
    ``files`` has path.
    """
    wanted = statements.select("src_path", "statement_id", "by_suffix", F.explode("candidates").alias("candidate")).filter(~F.col("candidate").rlike(r"^\.\.(/|$)"))
    exact = wanted.join(files.select(F.col("path").alias("candidate"), F.col("path").alias("dst_path")), "candidate").filter("src_path <> dst_path").select("src_path", "statement_id", "dst_path")
    open_ones = wanted.filter("by_suffix").join(exact.select("src_path", "statement_id").distinct(), ["src_path", "statement_id"], "left_anti")
    tails = files.select(F.col("path").alias("dst_path"), F.explode(path_suffixes(F.col("path"))).alias("candidate"))
    by_tail = open_ones.join(tails, "candidate").filter("src_path <> dst_path").select("src_path", "statement_id", "dst_path")
    found = exact.union(by_tail).groupBy("src_path", "statement_id").agg(F.countDistinct("dst_path").alias("n"), F.min("dst_path").alias("dst_path"))
    return found.filter("n = 1").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), F.lit("imports").alias("kind"), F.lit(EDGE_WEIGHTS["imports"]).alias("weight")).distinct()


def covers(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, at, start, end, span_id) of every point and every span of its key that covers it.

    An equi-join at any number of spans a key: a span of a length up to 2**k lies in one or two
    cells of that width, and a point looks into the cell it is in at each level that occurs (at
    most 64). So a hot key is dealt over as many keys as it has cells.
    """
    length = F.col("end") - F.col("start")
    sized = spans.filter("start <= end").withColumn("level", F.when(length > 0, F.length(F.bin(length.cast("long")))).otherwise(0))
    levels = sorted(r[0] for r in sized.select("level").distinct().collect())
    cell = lambda at, k: F.call_function("shiftright", at.cast("long"), k.cast("int"))
    in_cells = sized.withColumn("cell", F.explode(F.sequence(cell(F.col("start"), F.col("level")), cell(F.col("end"), F.col("level")))))
    looks = points.select(key, "at", F.explode(F.lit(levels).cast("array<int>")).alias("level")).withColumn("cell", cell(F.col("at"), F.col("level")))
    return looks.join(in_cells, [key, "level", "cell"]).filter((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end"))).select(key, "at", "start", "end", "span_id")


def narrowest_cover(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For each point the narrowest span of its key that covers it, ties by the span's id."""
    joined = covers(points, spans, key)
    return joined.groupBy(key, "at").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), F.col("span_id").alias("id"))).alias("m")).select(key, "at", F.col("m.id").alias("span_id"), F.col("m.width").alias("width"))


def changed_together(changes: DataFrame, least: int = 2, support: float = 0.5, most_per_commit: int = 20, across: bool = False) -> DataFrame:
    """(a, b, commits, support): pairs of symbols that changed in the same commits.

    Commits of more than ``most_per_commit`` symbols are left out before the self-join, which
    bounds the pairs a commit can give.
    """
    # The limit of 20 is part of the operator: larger commits say nothing about a pair.
    rows = changes.distinct()
    size = rows.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_per_commit)
    rows = rows.join(size.select("commit"), "commit", "left_semi")
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    cols = ["commit", "symbol", *(["path"] if across else [])]
    x, y = rows.select(*[F.col(c).alias(c if c == "commit" else f"{c}_a") for c in cols]), rows.select(*[F.col(c).alias(c if c == "commit" else f"{c}_b") for c in cols])
    pairs = x.join(y, "commit").filter("symbol_a < symbol_b" + (" and path_a <> path_b" if across else ""))
    together = pairs.groupBy("symbol_a", "symbol_b").agg(F.count(F.lit(1)).alias("commits")).filter(F.col("commits") >= least)
    a, b = counts.select(F.col("symbol").alias("symbol_a"), F.col("n").alias("n_a")), counts.select(F.col("symbol").alias("symbol_b"), F.col("n").alias("n_b"))
    rated = together.join(a, "symbol_a").join(b, "symbol_b").withColumn("support", F.col("commits") / F.greatest("n_a", "n_b"))
    return rated.filter(F.col("support") >= support).select(F.col("symbol_a").alias("a"), F.col("symbol_b").alias("b"), "commits", "support")


def capped_degree(pairs: DataFrame, most: int = 8, rounds: int = 64) -> DataFrame:
    """Pairs kept greedily, most commits first, while both ends have fewer than ``most`` partners.

    Rounds on DataFrames instead of a fold over all pairs: in each round a pair is settled if
    it is among the first (capacity left) open pairs of both of its ends. That is what the
    ordered fold decides for it, since nothing open stands before it.
    """
    from corpusgraph.plans.lineage import written

    order = [F.desc("commits"), F.asc("a"), F.asc("b")]
    still = written(pairs.withColumn("taken", F.lit(False)), "degree")
    for _ in range(rounds):
        used = still.filter("taken").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("used"))
        ua, ub = used.select(F.col("node").alias("a"), F.col("used").alias("used_a")), used.select(F.col("node").alias("b"), F.col("used").alias("used_b"))
        waiting = still.filter("not taken").join(ua, "a", "left").join(ub, "b", "left").fillna(0, ["used_a", "used_b"])
        waiting = waiting.filter((F.col("used_a") < most) & (F.col("used_b") < most))
        ends = waiting.select("a", "b", "commits", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("used_a").alias("used")), F.struct(F.col("b").alias("node"), F.col("used_b").alias("used")))).alias("e")).select("a", "b", "commits", "e.node", "e.used")
        ranked = ends.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter(F.col("k") <= most - F.col("used"))
        sure = ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b", F.lit(True).alias("now"))
        open_pairs = waiting.select("a", "b", "commits", "support").join(sure, ["a", "b"], "left").select("a", "b", "commits", "support", F.coalesce("now", F.lit(False)).alias("taken"))
        still = written(still.filter("taken").unionByName(open_pairs), "degree")
        if still.filter("not taken").isEmpty():
            break
    else:
        raise RuntimeError("the degree cap did not settle")
    return still.filter("taken").drop("taken")

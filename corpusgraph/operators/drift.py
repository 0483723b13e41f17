"""Snapshots against each other: changed, removed and renamed content, stale anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unchanged(new: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and hash are known: nothing to do for them."""
    return new.join(known.select("path", "file_hash"), ["path", "file_hash"], "left_semi")


def changed(new: DataFrame, known: DataFrame) -> DataFrame:
    return new.join(known.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def removed(new: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(new.select("path"), "path", "left_anti")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old and new path and symbol) of bodies unique on both sides whose old place is gone."""
    one = lambda df, p: df.groupBy("body_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "symbol")).alias(p)).filter("n = 1").select("body_hash", p)
    moved = one(old, "o").join(one(new, "w"), "body_hash").filter("o.path <> w.path or not (o.symbol <=> w.symbol)")
    flat = moved.select("body_hash", F.col("o.path").alias("old_path"), F.col("o.symbol").alias("old_symbol"), F.col("w.path").alias("new_path"), F.col("w.symbol").alias("new_symbol"))
    still = new.select(F.col("path").alias("p"), F.col("symbol").alias("s"))
    return flat.join(still, (F.col("old_path") == F.col("p")) & F.col("old_symbol").eqNullSafe(F.col("s")), "left_anti")


def move_anchors(memories: DataFrame, moves: DataFrame) -> DataFrame:
    """Anchors of moved spans follow; the first place they came from is kept."""
    m = moves.select(F.col("old_path").alias("mp"), F.col("old_symbol").alias("ms"), "new_path", "new_symbol")
    joined = memories.join(m, (F.col("path") == F.col("mp")) & F.col("symbol").eqNullSafe(F.col("ms")), "left")
    hit = F.col("new_path").isNotNull()
    return joined.select(
        "id",
        F.coalesce("new_path", "path").alias("path"),
        F.when(hit, F.col("new_symbol")).otherwise(F.col("symbol")).alias("symbol"),
        "span_hash",
        F.when(hit, F.coalesce(F.col("moved_from"), F.concat_ws("::", "path", "symbol"))).otherwise(F.col("moved_from")).alias("moved_from"),
    )


def live_state(memories: DataFrame, current: DataFrame) -> DataFrame:
    """``memories`` with the state that the current hashes give; stale is sticky."""
    now = current.select(F.col("path").alias("cp"), F.col("symbol").alias("cs"), F.col("span_hash").alias("now_hash"))
    joined = memories.join(now, (F.col("path") == F.col("cp")) & F.col("symbol").eqNullSafe(F.col("cs")), "left")
    same = F.col("span_hash").eqNullSafe(F.col("now_hash")) & F.col("moved_from").isNull()
    return joined.withColumn("live", F.when(F.col("state") != "fresh", F.col("state")).when(same, "fresh").otherwise("stale")).drop("cp", "cs", "now_hash")


def drift_rate(states: DataFrame) -> DataFrame:
    """checked, fresh, drifted and drift_rate_pct of rows with a ``live`` state."""
    fresh = F.sum((F.col("live") == "fresh").cast("long"))
    n = F.count(F.lit(1))
    return states.agg(n.alias("checked"), F.coalesce(fresh, F.lit(0)).alias("fresh")).select("checked", "fresh", (F.col("checked") - F.col("fresh")).alias("drifted"), F.round(F.coalesce(F.try_divide(100.0 * (F.col("checked") - F.col("fresh")), F.col("checked")), F.lit(0.0)), 2).alias("drift_rate_pct"))


def last_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The last row of each key by one aggregate, without a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(F.col(order_col), *[F.col(c) for c in rest if c != order_col])).alias("m"))
    return picked.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: str = "created_at") -> DataFrame:
    """``new`` over ``old``: replaced rows keep when they were created."""
    n = new.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("is_new"))
    both = old.join(n, keys, "full_outer")
    cols = [c for c in old.columns if c not in keys]
    pick = lambda c: F.coalesce(c, f"n_{c}") if c == kept else F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(c))
    return both.select(*keys, *[pick(c).alias(c) for c in cols])


def cascade(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that don't touch any of the deleted nodes."""
    ids = gone.select(F.col("id").alias("gone_id"))
    return edges.join(ids, F.col("src") == F.col("gone_id"), "left_anti").join(ids, F.col("dst") == F.col("gone_id"), "left_anti")

"""URL filters by a temporal list join, in DataFrame functions only.

List entries are dated: (list, action, pattern, dated, listed), where ``listed`` tells whether
the entry goes onto the list or off it from that date on. Successive entries of one list and
pattern become validity intervals [from, until). Every capture is then judged by an as-of join:
against the entries that are active at its fetch time and whose pattern is its host or a parent
domain, or such a domain with leading segments of its path. The most specific active entry
decides, a block before an allow of the same pattern.

The join works on distinct places, a host with the first segment of a path. A place's domains
(its host's suffixes, bounded by its labels) meet the patterns by an equi-join on domain and first
segment; what matches is gathered for each place, and captures pick up their place's candidates
by one more equi-join. Places that hold more than a ``HOT``-th of all captures, of which there are
fewer than ``HOT``, are salted in that join. Interval and path tests then run on each capture's
own array, so captures are neither exploded nor regrouped. No side is broadcast by hint.

Defined cases: a null URL, or one without a scheme and host, has a null host and isn't blocked;
entries with a null list, action, pattern or date are ignored; entries of one list, pattern and
date count once, ``listed`` prevailing; a pattern's path matches whole segments (``/fr`` is not
``/french``), a slash at its end means nothing; a null fetch time meets no entry; repeated
captures are judged each; an empty list blocks nothing; other columns pass through, except for
those that have the names of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import col

RESULT = ("host", "n_active", "deciding_list", "deciding_pattern", "blocked")
FOREVER = "9999-12-31"
HOT = 1000
SALTS = 64


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, path, list, action, pattern, valid_from, valid_until) of dated entries."""
    clean = (
        entries.filter(F.col("list").isNotNull() & F.col("action").isNotNull() & F.col("pattern").isNotNull() & F.col("dated").isNotNull())
        .withColumn("pattern", F.rtrim(F.lower("pattern"), F.lit("/")))
        .groupBy("list", "action", "pattern", "dated")
        .agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    )
    following = F.lead("dated").over(Window.partitionBy("list", "action", "pattern").orderBy("dated"))
    return (
        clean.withColumn("valid_until", F.coalesce(following, F.to_timestamp(F.lit(FOREVER))))
        .filter("listed")
        .select(
            F.substring_index("pattern", "/", 1).alias("domain"),
            F.when(F.instr("pattern", "/") > 0, F.expr("substring(pattern, instr(pattern, '/'))")).otherwise(F.lit("")).alias("path"),
            "list", "action", "pattern", F.col("dated").alias("valid_from"), "valid_until",
        )
    )


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def path_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1))


def first_segment(path):
    return F.split_part(path, F.lit("/"), F.lit(2))


def judge(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with host, n_active, deciding_list, deciding_pattern and blocked."""
    kept = [c for c in captures.columns if c.lower() not in RESULT]
    rows = captures.select(F.struct(*[col(c) for c in kept]).alias("r"), col(url_col).alias("u"), col(time_col).alias("t")).withColumn("host", host_of(F.col("u"))).withColumn("p", path_of(F.col("u"))).withColumn("seg", first_segment(F.col("p")))
    counts = rows.filter(F.col("host").isNotNull()).groupBy("host", "seg").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [(r[0], r[1]) for r in counts.filter(F.col("n") * HOT > total).select("host", "seg").collect()]
    place = F.concat_ws("/", "host", "seg")
    salts = F.when(place.isin(["/".join(h) for h in hot]), SALTS).otherwise(1) if hot else F.lit(1)
    labels = F.split("host", r"\.")
    domains = counts.select("host", "seg", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    entry = F.struct(F.length("pattern").alias("depth"), (F.col("action") == "block").alias("block"), "list", "pattern", "path", "valid_from", "valid_until")
    listed = intervals(entries).withColumn("first", F.when(F.col("path") != "", first_segment(F.col("path"))))
    # A pattern without a path meets every segment of its domain, one with a path only its own.
    whole = domains.join(listed.filter("first is null"), "domain").select("host", "seg", entry.alias("e"))
    below = domains.join(listed.filter("first is not null"), (domains["domain"] == listed["domain"]) & (F.col("seg") == F.col("first"))).select("host", "seg", entry.alias("e"))
    may = whole.unionByName(below).groupBy("host", "seg").agg(F.collect_list("e").alias("may"))
    spread = may.select(F.col("host").alias("h"), F.col("seg").alias("g"), "may", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    # Each salt finds the same candidates, so that it doesn't matter which one a row draws.
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    joined = salted.join(spread, (F.col("host") == F.col("h")) & (F.col("seg") == F.col("g")) & (F.col("salt") == F.col("s")), "left")
    at_segment = lambda e: (e["path"] == "") | (F.col("p") == e["path"]) | F.col("p").startswith(F.concat(e["path"], F.lit("/")))
    active = F.filter(
        F.coalesce("may", F.expr("cast(array() as array<struct<depth:int,block:boolean,list:string,pattern:string,path:string,valid_from:timestamp,valid_until:timestamp>>)")),
        lambda e: (e["valid_from"] <= F.col("t")) & (F.col("t") < e["valid_until"]) & at_segment(e),
    )
    judged = joined.withColumn("active", active)
    most = F.array_max(F.transform("active", lambda e: F.struct(e["depth"].alias("depth"), e["block"].alias("block"))))
    # Among equally specific entries of one action the least list name speaks.
    decides = F.array_min(F.transform(F.filter("active", lambda e: (e["depth"] == F.col("m.depth")) & (e["block"] == F.col("m.block"))), lambda e: F.struct(e["list"].alias("list"), e["pattern"].alias("pattern"))))
    return (
        judged.withColumn("m", most)
        .withColumn("d", decides)
        .select("r.*", "host", F.size("active").cast("long").alias("n_active"), F.col("d.list").alias("deciding_list"), F.col("d.pattern").alias("deciding_pattern"), F.coalesce("m.block", F.lit(False)).alias("blocked"))
    )

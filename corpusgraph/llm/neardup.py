"""Near-copy removal for the pipeline: SimHash links first, an exact set join for the rest.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at
least 0.8. Fingerprints at most two bits apart (:mod:`corpusgraph.llm.simhash`, by pigeonring)
give the first candidates; but such texts may differ in far more bits, so the links that
fingerprints don't show are found by prefix filtering, which loses none: of two such texts of n
and m shingles, each shares at least ceil(0.8 n) and ceil(0.8 m) of them with the other, so in
any common order of all shingles the first n - ceil(0.8 n) + l of the one and
m - ceil(0.8 m) + l of the other have l in common.

1. ``partnered``: in the order of their hashes, each distinct text shows its first shingles,
   with l a tenth of its set. A text of which fewer than the share that any partner must have
   in common occur in some other text's first ones has no near copy and goes.
2. The fingerprints of the texts left are linked, and groups of links form.
3. ``prefixes``: these texts show their first shingles (l = 1) in the order of how many of
   them have a shingle, so that passages that very many texts have come last.
4. ``links``: texts that show the same shingle form a bucket. Only the groups matter, not all
   links: first each member is compared with the bucket's most central one, and while crowded
   buckets (more than ``BUCKET`` members) of several groups are left, at most ``ROUNDS`` times,
   with another one. In the end every two members of a bucket that aren't in one group yet are
   compared, however many; so rounds spare comparisons and never replace them.

Before shingle sets are compared, their rings are: ``WORDS`` segments of 64 bits, in which each
shingle flips one bit. Two sets whose symmetric difference is d have rings at most d bits apart,
and near copies differ in at most a ninth of n + m, so whoever exceeds this budget over the
whole ring is no near copy. Comparisons that decide are exact: sizes of intersections of whole
shingle sets.

Defined cases: equal texts are copies, null texts of each other too; of a group the row with
the least doc_id stays (a null doc_id only where there is no other); of repeated rows of one id
and text the one with the least hash of its columns stays; texts without words and texts of
fewer than five words match only texts of the same words; an empty table stays empty; all
columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm import simhash
from corpusgraph.llm.common import col, components, cut, map_text, scratch
from corpusgraph.llm.simhash import hash_chunks, shingle_hashes  # noqa: F401  the tests' brute force uses the latter

SHINGLE = 5
BUCKET = 48
ROUNDS = 3
WORDS = 16
#: Similarity 0.8 as a ratio of integers, so that no bound is rounded.
ABOVE, BELOW = 4, 5


def least_common(n: int) -> int:
    """How many of its n shingles a text shares with any near copy, at least."""
    return -(-ABOVE * n // BELOW)


def first_shown(n: int) -> int:
    """Number of shingles that :func:`partnered` looks at."""
    return n - least_common(n) + max(1, n // 10)


def first_common(n: int) -> int:
    """How many of them a near copy, of least_common(n) shingles at least, shows too."""
    return max(1, least_common(n) // 10)


def shingle_set(text: str | None) -> np.ndarray:
    """Signed hashes of the text's distinct shingles in order; texts without words share one."""
    return _distinct([np.array(c, dtype=np.uint64) for c in hash_chunks(text, SHINGLE)])


def _distinct(chunks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(c) for c in chunks] if len(chunks) > 1 else chunks).view(np.int64)) if chunks else np.zeros(1, dtype=np.int64)


def set_and_print(text: str | None) -> tuple[np.ndarray, int]:
    """The shingle set and the fingerprint of a text, whose shingles are hashed once."""
    chunks, counts, n = [], 0, 0
    for c in hash_chunks(text, SHINGLE):
        hashes = np.array(c, dtype=np.uint64)
        chunks.append(hashes if len(c) < 1 << 17 else np.unique(hashes))
        counts, n = counts + simhash.bit_counts(hashes), n + len(c)
    return _distinct(chunks), simhash.majority(counts, n)


def ring_of(hashes: np.ndarray) -> np.ndarray:
    """The set's ring: bit b of segment s is flipped by each hash that begins with s and b."""
    at = (hashes.view(np.uint64) >> np.uint64(64 - 10)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).view(">i8").astype(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)))


def partnered(texts: DataFrame) -> DataFrame:
    """(node, fp) of each text that may have a near copy; ``texts`` may repeat a node."""

    def make():
        def f(texts):
            shown, need, prints = [], [], []
            for s in texts:
                x, fp = set_and_print(s.as_py())
                prints.append(fp)
                shown.append(x[: first_shown(len(x))])
                need.append(first_common(len(x)))
            return [_lists(shown), need, prints]

        return f

    shown = map_text(texts, make, [("hs", "array<long>"), ("need", "int"), ("fp", "long")], text="text", keep=["node"])
    shown = cut(shown.groupBy("node").agg(F.first("hs").alias("hs"), F.first("need").alias("need"), F.first("fp").alias("fp")), "neardup-shown")
    one = shown.select("node", F.explode("hs").alias("h"))
    shared = one.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    common = one.join(shared, "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return cut(common.join(shown.select("node", "need", "fp"), "node").filter("n >= need").select("node", "fp"), "neardup-partnered")


def print_pairs(wanted: DataFrame) -> DataFrame:
    """(a, b) of nodes with equal fingerprints or linked ones, each meeting its print's least node."""
    least = cut(wanted.groupBy("fp").agg(F.min("node").alias("rep")), "neardup-prints")
    same = wanted.join(least, "fp").filter("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    a, b = least.select(F.col("fp").alias("a"), F.col("rep").alias("x")), least.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    near = simhash.links(least.select("fp")).join(a, "a").join(b, "b").select("x", "y")
    return same.union(near)


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, n, central, h, at): shingles that each set shows, at their places in the order.

    ``central`` is the mean number of sets that have a shingle of this one.
    """
    one = sets.select("node", "n", F.explode("hs").alias("h"))
    df = one.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    seen = one.join(df, "h")
    of = Window.partitionBy("node")
    # Shingles of one set only come first in the order and needn't be shown.
    alone = F.col("n") - F.count(F.lit(1)).over(of)
    ranked = seen.withColumn("at", alone + F.row_number().over(of.orderBy("df", "h")) - 1).withColumn("central", F.sum("df").over(of) / F.col("n"))
    shown = F.col("n") - F.ceil(F.col("n") * ABOVE / BELOW).cast("int") + 1
    return cut(ranked.filter(F.col("at") < shown).select("node", "n", "central", "h", "at"), "neardup-prefixes")


def _sizes_fit(n, m):
    return (n * BELOW >= m * ABOVE) & (m * BELOW >= n * ABOVE)


def _rings_fit(x: str, y: str, n, m):
    """Whether two rings differ within the budget of near copies of n and m shingles."""
    apart = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(WORDS)), F.lit(0))
    return apart * (ABOVE + BELOW) <= (BELOW - ABOVE) * (n + m)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the whole shingle sets are similar enough."""
    r, q = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("ring").alias(f"ring_{k}")) for k in "ab")
    near = pairs.join(r, "a").join(q, "b").filter(_sizes_fit(F.col("n_a"), F.col("n_b")) & _rings_fit("ring_a", "ring_b", F.col("n_a"), F.col("n_b")))
    x, y = (sets.select(F.col("node").alias(k), F.col("hs").alias(f"hs_{k}")) for k in "ab")
    common = F.size(F.array_intersect("hs_a", "hs_b"))
    return near.select("a", "b", "n_a", "n_b").join(x, "a").join(y, "b").filter(common * (ABOVE + BELOW) >= ABOVE * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(shown: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several groups, with their roots."""
    rooted = shown.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select(*shown.columns, F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("h")
    return cut(rooted.join(several, "h", "left_semi"), "neardup-mixed")


def links(texts: DataFrame, firsts: DataFrame, repeats: bool) -> DataFrame:
    """(node, root) of each node that has a near copy.

    ``firsts`` has one row id ``i`` for each node of ``texts`` (i, node, text); ``repeats`` tells
    whether rows of the same id and text occur.
    """
    candidates = partnered(texts)
    wanted = candidates.join(firsts.select("node", "i"), "node").select(F.col("node").alias("fn"), F.col("i").alias("fi"))
    some = texts.join(wanted, (F.col("node") == F.col("fn")) & F.col("i").eqNullSafe(F.col("fi")), "left_semi").select("node", "text")
    some = some.dropDuplicates(["node"]) if repeats else some

    def make():
        def f(texts):
            found = [shingle_set(s.as_py()) for s in texts]
            return [_lists(found), [len(x) for x in found], _lists([ring_of(x) for x in found])]

        return f

    sets = cut(map_text(some, make, [("hs", "array<long>"), ("n", "int"), ("ring", "array<long>")], text="text", keep=["node"]), "neardup-sets")
    found = cut(similar(_ordered(print_pairs(candidates)), sets), "neardup-links")
    roots = cut(components(found), "neardup-roots")
    shown = prefixes(sets)
    mixed = _mixed(shown, roots)
    for k in range(ROUNDS + 1):
        # The first round meets all buckets, later ones those that are still crowded and mixed.
        order = F.col("central") if k == 0 else F.xxhash64("root", F.lit(k))
        best = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(order.alias("o"), "node", "n", "root")).alias("best"))
        best = best.filter(F.col("size") > (1 if k == 0 else BUCKET)).select("h", F.col("best.node").alias("b"), F.col("best.n").alias("m"), F.col("best.root").alias("r"))
        met = mixed.join(best, "h").filter((F.col("root") != F.col("r")) & _sizes_fit(F.col("n"), F.col("m"))).select(F.col("node").alias("a"), "b")
        more = cut(similar(_ordered(met), sets), "neardup-links")
        if more.isEmpty():
            if k:
                break
            continue
        found = cut(found.union(more), "neardup-links")
        roots = cut(components(found), "neardup-roots")
        mixed = _mixed(shown, roots)
    ringed = mixed.join(sets.select("node", "ring"), "node")
    x, y = (ringed.select("h", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"i{k}"), F.col("root").alias(f"r{k}"), F.col("ring").alias(f"ring_{k}")) for k in "ab")
    # What can be common before this shingle, it, and what can be behind it.
    bound = F.least("ia", "ib") + 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    fits = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sizes_fit(F.col("na"), F.col("nb")) & (bound * (ABOVE + BELOW) >= ABOVE * (F.col("na") + F.col("nb")))
    rest = cut(x.join(y, "h").filter(fits & _rings_fit("ring_a", "ring_b", F.col("na"), F.col("nb"))).select("a", "b").distinct(), "neardup-rest")
    if rest.isEmpty():
        return roots
    last = cut(similar(rest, sets), "neardup-links")
    return roots if last.isEmpty() else components(found.union(last))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of copies and near copies."""
    first, second = F.xxhash64(col(text_col)), F.xxhash64(F.lit(1), col(text_col))
    with scratch() as keep:
        # A text is known by one hash of 64 bits; texts whose hash another text has, of which a
        # corpus of t texts holds about t*t / 2**64, are told by a second hash and go by that.
        twice = docs.select(first.alias("k"), second.alias("s")).groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo != hi")
        clash = [r[0] for r in twice.select("k").collect()]
        node = F.when(first.isin(clash), second).otherwise(first) if clash else first
        keyed = docs.select(col(id_col).alias("i"), node.alias("node"))
        firsts = cut(keyed.groupBy("node").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n")), "neardup-firsts")
        repeated = keep(cut(keyed.groupBy("i", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("i").alias("ri"), F.col("node").alias("rn")), "neardup-repeated"))
        repeats = not repeated.isEmpty()
        texts = docs.select(col(id_col).alias("i"), node.alias("node"), col(text_col).alias("text"))
        roots = links(texts, firsts, repeats)
        grouped = firsts.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select("node", "i", F.coalesce("root", "node").alias("root"))
        # The least doc_id of a group stays; where all are null, the least text key decides.
        best = grouped.groupBy("root").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "node")).alias("m"))
        stay = keep(cut(best.select(F.col("m.i").alias("si"), F.col("m.node").alias("sn")), "neardup-stay"))
    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("i"), node.alias("node"))
    kept = marked.join(stay, (F.col("node") == F.col("sn")) & F.col("i").eqNullSafe(F.col("si")), "left_semi")
    if repeats:
        same = (F.col("node") == F.col("rn")) & F.col("i").eqNullSafe(F.col("ri"))
        several = kept.join(repeated, same, "left_semi").groupBy("i", "node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(repeated, same, "left_anti").select("row").unionByName(several.select("row"))
    return kept.select("row.*")

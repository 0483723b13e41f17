"""Size-balanced sharding by best-fit-decreasing bin packing.

Documents with equal text form an indivisible group. Groups enter, largest first, the bin with
the tightest sufficient remaining capacity, found through a balanced (AVL) tree. Groups of one
size are alike, and once a bin is the tightest for a size it stays so until it can't hold one
more; so a step of the packer deals all groups of a size that the bin can take, and the packing
is that of every single group. What the packer sees is the number of groups of each size:
sizes count exactly up to 2**``EXACT_BITS`` bytes and are rounded up in the 2**``DIGITS``-th
beyond, which bounds these numbers by 100,000 at any corpus size. The fixed capacity is the
smallest one (within a 50,000th) at which ``n_shards`` bins hold everything, found by bisection,
so sizes come out near equal.

Groups of a size that go to several bins are dealt in the order of ranks, which are made in
buckets of at most about ``SLOT_ROWS`` groups, as are the slots of rows in a shard.

With ``whole`` (the default) no group is ever divided, and one larger than a shard's share is a
shard of its own beyond the others' size. Where sizes have to come out near equal whatever the
groups are, ``whole=False`` deals a group larger than a share in pieces of about a quarter of it.

Defined cases: a null text has no bytes (size is the overhead alone), null checksum, and
forms one group with other null texts; repeated rows are separate rows with slots of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, cut

OVERHEAD = 16
EXACT_BITS = 16
DIGITS = 10
SLOT_ROWS = 100_000


class FreeSpace:
    """AVL tree of (remaining capacity, bin); ``tightest`` finds the least that suffices."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _fixed(n):
        deep = lambda x: x[3] if x else 0
        make = lambda key, lo, hi: (key, lo, hi, 1 + max(deep(lo), deep(hi)))
        key, lo, hi = n
        if deep(lo) > deep(hi) + 1:
            if deep(lo[1]) < deep(lo[2]):
                mid = lo[2]
                lo = make(mid[0], make(lo[0], lo[1], mid[1]), mid[2])
            return make(lo[0], lo[1], make(key, lo[2], hi))
        if deep(hi) > deep(lo) + 1:
            if deep(hi[2]) < deep(hi[1]):
                mid = hi[1]
                hi = make(mid[0], mid[1], make(hi[0], mid[2], hi[2]))
            return make(hi[0], make(key, lo, hi[1]), hi[2])
        return make(key, lo, hi)

    def add(self, key) -> None:
        def put(n):
            if n is None:
                return (key, None, None, 1)
            return self._fixed((n[0], put(n[1]), n[2]) if key < n[0] else (n[0], n[1], put(n[2])))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut_least(n):
            if n[1] is None:
                return n[0], n[2]
            least, rest = cut_least(n[1])
            return least, self._fixed((n[0], rest, n[2]))

        def drop(n):
            if key < n[0]:
                return self._fixed((n[0], drop(n[1]), n[2]))
            if key > n[0]:
                return self._fixed((n[0], n[1], drop(n[2])))
            if n[1] is None or n[2] is None:
                return n[1] or n[2]
            least, rest = cut_least(n[2])
            return self._fixed((least, n[1], rest))

        self.root = drop(self.root)

    def tightest(self, size: int):
        n, found = self.root, None
        while n:
            if n[0] >= (size, -1):
                found, n = n[0], n[1]
            else:
                n = n[2]
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, most: int) -> list[int] | None:
    """Bin of each item, or None when ``most`` bins of ``capacity`` don't hold them."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    runs = best_fit_runs(sorted(counts.items(), reverse=True), capacity, most)
    if runs is None:
        return None
    out, dealt = [0] * len(sizes), iter([at for some in runs for at, k in some for _ in range(k)])
    for i in order:
        out[i] = next(dealt)
    return out


def best_fit_runs(counts: list[tuple[int, int]], capacity: int, most: int) -> list[list[tuple[int, int]]] | None:
    """For each (size, number of items), sizes falling: runs (bin, number) in the order of dealing."""
    free, used, out = FreeSpace(), 0, []
    for size, n in counts:
        runs = []
        while n:
            at = free.tightest(size)
            if at is None:
                if used == most or size > capacity:
                    return None
                at, used = (capacity, used), used + 1
            else:
                free.remove(at)
            k = min(n, at[0] // size)
            free.add((at[0] - k * size, at[1]))
            runs.append((at[1], k))
            n -= k
        out.append(runs)
    return out


def pack(counts: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing at the least capacity (within 1/50000) for which ``bins`` suffice."""
    if not counts:
        return []
    low = max(-(-sum(s * n for s, n in counts) // bins), counts[0][0])
    step = max(1, low // 50_000)
    if best := best_fit_runs(counts, low, bins):
        return best
    high = low + step
    while not (best := best_fit_runs(counts, high, bins)):
        low, high = high, high + 2 * (high - low)
    while high - low > step:
        mid = (low + high) // 2
        if got := best_fit_runs(counts, mid, bins):
            best, high = got, mid
        else:
            low = mid
    return best


def size_class(size):
    """The size, rounded up beyond 2**EXACT_BITS to that many leading binary digits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(DIGITS + 1))
    unit = F.when(size > (1 << EXACT_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), drop.cast("int"))).otherwise(F.lit(1).cast("long"))
    return (F.ceil(size / unit) * unit).cast("long")


def _ranked(rows: DataFrame, key: str, buckets, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 within each ``key``; no task ranks a whole key.

    ``buckets`` is the number of parts of a key, a column of its own.
    """
    parted = rows.withColumn("part", F.pmod(F.xxhash64(*order, F.lit(3)), buckets))
    sizes = parted.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n_in"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("rk"), F.col("part").alias("rp"), F.coalesce(F.sum("n_in").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    ranked = parted.withColumn("in_part", local).join(starts, (F.col(key) == F.col("rk")) & (F.col("part") == F.col("rp")))
    return ranked.withColumn("rank", (F.col("start") + F.col("in_part") - 1).cast("long")).drop("rk", "rp", "start", "in_part", "part")


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", *, whole: bool = True) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_key for every row."""
    spark = docs.sparkSession
    raw = col(text_col).cast("binary")
    # A number for each row, fixed by writing it, spreads rows that are alike in all else.
    base = cut(
        docs.select(
            col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(col(text_col)).alias("group_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    n_rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1, -(-total // n_shards))
    groups, large = base.groupBy("group_key").agg(F.sum("size").alias("bytes")), None
    keyed = base.withColumn("piece", F.lit(0))
    if not whole:
        # Fewer groups than shards are larger than a share.
        large = [(r[0], -(-4 * r[1] // share)) for r in groups.filter(F.col("bytes") > share).collect()]
    if large:
        n_pieces = F.element_at(F.create_map(*[F.lit(x) for kv in large for x in kv]), F.col("group_key"))
        keyed = base.withColumn("piece", F.when(F.col("group_key").isin([k for k, _ in large]), F.pmod(F.xxhash64("row", F.lit(2)), n_pieces).cast("int")).otherwise(0))
        groups = keyed.groupBy("group_key", "piece").agg(F.sum("size").alias("bytes"))
    else:
        groups = groups.withColumn("piece", F.lit(0))
    groups = cut(groups.withColumn("class", size_class(F.col("bytes"))).select("group_key", "piece", "class"), "shard-groups")
    counts = sorted(((r[0], r[1]) for r in groups.groupBy("class").count().collect()), reverse=True)
    runs = pack(counts, n_shards)
    one = spark.createDataFrame([(size, some[0][0]) for (size, _), some in zip(counts, runs, strict=True) if len(some) == 1], "c long, s_one int")
    placed = groups.join(F.broadcast(one), F.col("class") == F.col("c"), "left").drop("c")
    several = [(size, n, some) for (size, n), some in zip(counts, runs, strict=True) if len(some) > 1]
    done = placed.filter("s_one is not null").select("group_key", "piece", F.col("s_one").alias("shard"))
    if several:
        rows = []
        for size, _, some in several:
            first = 0
            for at, k in some:
                rows.append((size, first, first + k, at))
                first += k
        ranges = spark.createDataFrame(rows, "c long, first long, beyond long, shard int")
        parts = spark.createDataFrame([(size, -(-n // SLOT_ROWS)) for size, n, _ in several], "c long, parts int")
        open_ones = placed.filter("s_one is null").join(F.broadcast(parts), F.col("class") == F.col("c")).drop("c")
        ranked = _ranked(open_ones, "class", F.col("parts"), ["group_key", "piece"])
        dealt = ranked.join(F.broadcast(ranges), (F.col("class") == F.col("c")) & (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("beyond")))
        done = done.unionByName(dealt.select("group_key", "piece", "shard"))
    placed_rows = keyed.join(done, ["group_key", "piece"]).select("doc_id", "size", "text_crc32", "group_key", "row", "shard")
    ranked = _ranked(placed_rows, "shard", F.lit(max(1, -(-n_rows // (n_shards * SLOT_ROWS)))), ["row"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key")

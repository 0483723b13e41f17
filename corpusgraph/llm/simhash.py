"""SimHash near-duplicates with pigeonring candidate filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word
shingles. Fingerprints at most ``2`` bits apart are linked, and components of links are the
groups of near copies.

Candidates come from the pigeonring principle over the distinct fingerprints. The 64 bits
form a ring of five segments. If two fingerprints differ in at most 2 bits, then from some
segment on, every chain of l consecutive segments differs in at most floor(2 l / 5) bits:
0, 0, 1, 1, 2. A chain's first two segments (25 or 26 bits) therefore agree exactly, which
makes the candidate search an equi-join on five keys for each fingerprint; the budgets of the
longer chains prune what it brings before the last one, which is the full Hamming check.

A bucket with more than ``BUCKET`` distinct fingerprints isn't joined with itself. Its
members agree on the two segments of the key, so two of them are linked exactly if they are
both within one bit of some word that has the same key; each member is sent to itself and
to its 38 or 39 one-bit variants outside of the key, and the members that meet at a variant
are linked to the least of them. That takes 40 rows for each member at any bucket size and
loses no link.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; a text of
fewer words than a shingle has one shingle of all its words; repeated rows and copies share
one fingerprint and aren't expanded into pairs; rows with a null doc_id get the component of
their fingerprint (null if no row there has a doc_id); an empty table gives an empty result;
very long texts are hashed in chunks whose bit counts add up; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import components, cut, map_text, scratch

BUCKET = 64
DISTANCE = 2
SEGMENTS = (13, 13, 13, 13, 12)
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")


def hash_chunks(text: str | None, size: int, chunk: int = CHUNK) -> Iterator[list[int]]:
    """XXH64 of the shingles in order, for about ``chunk`` bytes of text at a time."""
    import xxhash

    h, raw, words, start, some = xxhash.xxh64_intdigest, (text or "").encode("utf-8", "surrogatepass"), [], 0, False
    while start < len(raw):
        stop = len(raw)
        if start + chunk < stop and (m := BLANK.search(raw, start + chunk)):
            stop = m.start()
        # The last words of a chunk begin the shingles that reach into the next one.
        words = [*(words[1 - size :] if some and size > 1 else [] if some else words), *raw[start:stop].lower().split()]
        start = stop
        if len(words) < size:
            continue
        some, whole, starts, at = True, b" ".join(words), [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [*starts[size:], at]
        yield [h(whole[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)]
    if words and not some:
        yield [h(b" ".join(words), 42)]


def shingle_hashes(text: str | None, size: int) -> list[int]:
    return [x for some in hash_chunks(text, size) for x in some]


def bit_counts(hashes) -> np.ndarray:
    return np.unpackbits(np.asarray(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts, n: int) -> int:
    """Signed 64-bit word of the bits that are set in over half of n hashes."""
    return int(np.packbits(counts * 2 > n).view(">i8")[0]) if n else 0


def fingerprint_of(hashes: list[int]) -> int:
    return majority(bit_counts(hashes), len(hashes)) if hashes else 0


def fingerprint(text: str | None, size: int) -> int:
    """As :func:`fingerprint_of` of all shingles, in memory bounded but for the words of a chunk."""
    counts, n = 0, 0
    for some in hash_chunks(text, size):
        counts, n = counts + bit_counts(some), n + len(some)
    return majority(counts, n)


def fingerprints(docs: DataFrame, shingle: int = 5, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``) with ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [[fingerprint(s.as_py(), shingle) for s in texts]]

    return map_text(docs, make, [("fp", "long")], text=text_col, keep=keep)


def _rings(fps: DataFrame) -> DataFrame:
    """fp in each of its five rotations: chain, key (the two leading segments), ring, width."""
    rows, start = [], 0
    for i, width in enumerate(SEGMENTS):
        ring = F.col("fp") if not start else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))
        two = width + SEGMENTS[(i + 1) % 5]
        rows.append(F.struct(F.lit(i).alias("chain"), F.shiftrightunsigned(ring, 64 - two).alias("key"), ring.alias("ring"), F.lit(64 - two).alias("rest")))
        start += width
    return fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.*")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs over distinct fingerprints whose components are those of all links."""
    rings = cut(_rings(fps), "simhash-rings")
    counts = rings.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sized = cut(rings.join(counts, ["chain", "key"]), "simhash-buckets")
    small = sized.filter(F.col("n") <= bucket)
    left, right = small.select("chain", "key", F.col("ring").alias("x"), F.col("fp").alias("a")), small.select("chain", "key", F.col("ring").alias("y"), F.col("fp").alias("b"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    third = F.when(F.col("chain") == 2, 12).otherwise(13)
    two = F.when(F.col("chain") >= 3, 25).otherwise(26)
    fourth = F.when(F.col("chain") == 1, 12).otherwise(13)
    ahead = lambda bits: F.bit_count(F.call_function("shiftrightunsigned", differ, (64 - bits).cast("int")))
    near = (
        (F.col("a") < F.col("b"))
        & (ahead(two + third) <= 1)
        & (ahead(two + third + fourth) <= 1)
        & (F.bit_count(differ) <= DISTANCE)
    )
    pairs = left.join(right, ["chain", "key"]).filter(near).select("a", "b")
    crowded = sized.filter(F.col("n") > bucket)
    one = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: F.col("ring").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    variants = crowded.select("fp", "chain", F.explode(F.concat(F.array("ring"), one)).alias("variant"))
    meets = variants.groupBy("chain", "variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = meets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 5, *, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    with scratch() as keep:
        prints = keep(cut(fingerprints(docs, shingle, keep=[id_col], text_col=text_col).toDF("doc_id", "fp"), "simhash-prints"))
        fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        roots = components(links(fps.select("fp"), bucket))
        rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = keep(cut(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components"))
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

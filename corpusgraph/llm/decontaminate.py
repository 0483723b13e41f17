"""Benchmark decontamination by a prefix-filtered containment join.

Words are maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z
lower-cased. A benchmark item gives windows of 13 consecutive words (one window of all its
words where it has fewer). Every occurrence of a window holds each of the window's words at
a known place, so it suffices to join documents and windows on a one-word prefix: the
window's rarest word, rarity being counted over the whole corpus. Each joined word position
fixes where the window would start; length and position bounds drop starts that don't fit,
and the words are then compared exactly. Hit ranges are merged for each document.

Benchmark words and windows go to the executors in blocks of about ``BLOCK_WORDS`` words, read and
held one block at a time, so neither the driver nor a broadcast grows with the benchmark. Long
items come in slices that share the words of a window, cut by the executors. A block is a
dictionary of its words and arrays of numbers, about 150 bytes a word at most: windows are places
in one array of word numbers. One block is the usual case; with more, the ranges found in each
block are merged for each document by a plain aggregation.

Defined cases: null or wordless texts have no words and no hits; items that are null or
wordless have no windows; equal windows of several items count for each of them; repeated
item rows count once; items with a null item_id mark words but are not listed; an empty
benchmark gives no hits; other columns pass through, or those kept by name do; one with the name
of a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm.common import cut, map_text, quoted, scratch

WINDOW = 13
BLOCK_WORDS = 1_000_000
SLICE_WORDS = 100_000
#: Bytes outside the word class become a space, A-Z become a-z.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def word_counts(docs: DataFrame, vocabulary: frozenset, text_col: str) -> dict[bytes, int]:
    """Occurrences over all documents of each word of a block's vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        import pyarrow as pa

        seen, wanted = Counter(), held.value
        for b in batches:
            for text in b.column("t").to_pylist():
                if text is not None:
                    seen.update([w for w in words_of(text) if w in wanted])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(F.col(quoted(text_col)).alias("t")).mapInArrow(count, "w binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("w").agg(F.sum("n")).collect()}


class Index:
    """Distinct windows of a block's items by their rarest words, as arrays of numbers."""

    def __init__(self, items: list[tuple], counts: dict[bytes, int], window: int):
        words = sorted({w for _, some in items for w in some}, key=lambda w: (counts.get(w, 0), w))
        # A word's number is its place in the order of rarity.
        self.number = {w: i for i, w in enumerate(words)}
        self.owners = sorted({str(i) for i, some in items if i is not None and some})
        owner = {s: k for k, s in enumerate(self.owners)}
        flat = np.fromiter((self.number[w] for _, some in items for w in some), dtype=np.int32)
        begins = np.cumsum([0, *(len(some) for _, some in items)])
        by_length: dict[int, list] = {}
        for (item_id, some), at in zip(items, begins, strict=False):
            if some:
                length = min(window, len(some))
                places = np.arange(at, at + len(some) - length + 1, dtype=np.int32)
                by_length.setdefault(length, []).append((places, -1 if item_id is None else owner[str(item_id)]))
        start, size, rare, word, who, ends = [], [], [], [], [], [0]
        for length, found in sorted(by_length.items()):
            places = np.concatenate([p for p, _ in found])
            items_of = np.repeat(np.array([o for _, o in found], dtype=np.int32), [len(p) for p, _ in found])
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[places])
            _, first, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * length))).ravel(), return_index=True, return_inverse=True)
            at = rows[first].argmin(axis=1).astype(np.int32)
            start.append(places[first])
            size.append(np.full(len(first), length, dtype=np.int32))
            rare.append(at)
            word.append(rows[first, at])
            pairs = np.unique(np.stack([same.ravel().astype(np.int64), items_of.astype(np.int64)], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            who.append(pairs[:, 1].astype(np.int32))
            ends.append(ends[-1] + np.bincount(pairs[:, 0], minlength=len(first)).cumsum())
            ends = [*ends[:-1], *ends[-1].tolist()]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.flat, self.who, self.ends = flat.tobytes(), join(who), np.array(ends, dtype=np.int64)
        order = np.argsort(join(word), kind="stable")
        self.window = order.astype(np.int32)
        self.start, self.size, self.rare = join(start)[order], join(size)[order], join(rare)[order]
        self.first = np.searchsorted(join(word)[order], np.arange(len(words) + 1)).astype(np.int32)

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged ranges of words hit, and the items with an occurring window."""
        n, found, seen = len(words), [], set()
        if not n or not self.number:
            return [], set()
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int32, count=n)
        text = ids.tobytes()
        for p in np.flatnonzero((ids >= 0) & (self.first[ids + 1] > self.first[ids])).tolist():
            for k in range(self.first[ids[p]], self.first[ids[p] + 1]):
                at, size = p - int(self.rare[k]), int(self.size[k])
                begin = 4 * int(self.start[k])
                if at >= 0 and at + size <= n and text[4 * at : 4 * (at + size)] == self.flat[begin : begin + 4 * size]:
                    found.append((at, at + size))
                    seen.add(int(self.window[k]))
        ids_of = {self.owners[o] for w in seen for o in self.who[self.ends[w] : self.ends[w + 1]]}
        return merged(found), ids_of


def merged(found: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _scan(docs: DataFrame, index: Index, keep: list[str] | None, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index = held.value

        def f(texts):
            n_words, flat, ids = [], [], []
            for s in texts.to_pylist():
                words = words_of(s) if s is not None else []
                ranges, items = index.hits(words)
                n_words.append(len(words))
                flat.append([x for r in ranges for x in r])
                ids.append(sorted(items))
            return [n_words, flat, ids]

        return f

    return map_text(docs, make, [("n_words", "long"), ("hit_ranges", "array<int>"), ("item_ids", "array<string>")], text=text_col, keep=keep)


def _sliced(benchmark: DataFrame, id_col: str, text_col: str, window: int, slice_words: int) -> DataFrame:
    """(i, k, t, n): words of each distinct item, long ones in slices that overlap by a window."""
    rows = benchmark.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).alias("t")).filter(F.col("t").isNotNull()).distinct()

    def cut_up(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, text in zip(b.column("i"), b.column("t"), strict=True):
                words = words_of(text.as_py())
                for k in range(max(1, -(-(len(words) - window + 1) // slice_words)) if words else 0):
                    some = words[k * slice_words : (k + 1) * slice_words + window - 1]
                    out.append((i.as_py(), k, b" ".join(some), len(some)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("i").type), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.int64())], names=["i", "k", "t", "n"])

    return rows.mapInArrow(cut_up, T.StructType([T.StructField("i", benchmark.schema[id_col].dataType), T.StructField("k", T.IntegerType()), T.StructField("t", T.BinaryType()), T.StructField("n", T.LongType())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` (columns ``keep``) with n_words, n_hit, n_items, items_sha256, contaminated.

    ``hit_ranges`` has the merged ranges of words hit as start, end, start, end and so on;
    ``item_ids`` the items whose windows occur, sorted as strings.
    """
    with scratch() as stays:
        sliced = cut(_sliced(benchmark, item_id_col, item_text_col, window, min(SLICE_WORDS, block_words)), "decontaminate-items")
        n_blocks = max(1, -(-sliced.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // block_words))
        fields = {"n_words", "hit_ranges", "item_ids"}
        kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fields]

        def block(b: int, of: DataFrame) -> Index:
            part = sliced if n_blocks == 1 else sliced.filter(F.pmod(F.xxhash64("i", "k", "t"), F.lit(n_blocks)) == b)
            items = [(r[0], bytes(r[1]).split(b" ")) for r in part.select("i", "t").collect()]
            vocabulary = frozenset(w for _, x in items for w in x)
            return Index(items, word_counts(of, vocabulary, text_col) if vocabulary else {}, window)

        if n_blocks == 1:
            out = _scan(docs, block(0, docs), kept, text_col)
        else:
            # Rows need a key of their own while the blocks' findings are brought together.
            key = "row" + "_" * (1 + max(map(len, docs.columns)))
            docs = stays(cut(docs.select(*[F.col(quoted(c)) for c in docs.columns], F.monotonically_increasing_id().alias(key)), "decontaminate-docs"))
            found = None
            for b in range(n_blocks):
                part = cut(_scan(docs, block(b, docs), [key], text_col), "decontaminate-block").filter((F.size("hit_ranges") > 0) | F.lit(b == 0))
                found = part if found is None else found.unionByName(part)
            per_row = found.groupBy(key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_ranges")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
            per_row = stays(cut(_merge_flat(per_row.withColumnRenamed(key, "k")), "decontaminate-found"))
            out = docs.select(key, *[F.col(quoted(c)) for c in kept]).join(per_row, F.col(key) == F.col("k")).drop(key, "k")
    n_hit = F.aggregate("hit_ranges", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["s"] + a["sign"] * x).alias("s"), (-a["sign"]).alias("sign")), lambda a: a["s"])
    return (
        out.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "item_ids"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def _merge_flat(df: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = []
            for x in b.column("flat").to_pylist():
                flat.append([y for r in merged(list(zip(x[::2], x[1::2], strict=True))) for y in r])
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n_words"), pa.array(flat, pa.list_(pa.int32())), b.column("item_ids")], names=["k", "n_words", "hit_ranges", "item_ids"])

    return df.mapInArrow(run, "k long, n_words long, hit_ranges array<int>, item_ids array<string>")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """Reference for tests: every window against every position of every document."""
    out = {}
    for doc_id, text in docs:
        words = words_of(text) if text is not None else []
        hit, ids = set(), set()
        for item_id, item in items:
            for w in windows_of(words_of(item), window) if item is not None else []:
                for p in range(len(words) - len(w) + 1):
                    if tuple(words[p : p + len(w)]) == w:
                        hit.update(range(p, p + len(w)))
                        ids.add(str(item_id))
        out[doc_id] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out

"""The operators of fixed results against brute force written here."""

import binascii
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import decontaminate, pii, pieces, sharding, simhash, topk
from corpusgraph.llm.common import components
from corpusgraph.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_op6_equals_brute_force(spark, small):
    prints = {i: simhash.fingerprint_of(simhash.shingle_hashes(t, 3)) & (2**64 - 1) for i, t in small}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(prints.items(), linked(prints), strict=True)}


def linked(prints: dict[int, int]) -> list[int]:
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in prints]


def test_fingerprint_by_hand():
    import xxhash

    text = "A b C d b c d"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.shingle_hashes(text, 3) == hashes and simhash.fingerprint_of(hashes) & (2**64 - 1) == want
    assert simhash.fingerprint_of([]) == 0 and simhash.shingle_hashes("x Y", 3) == [xxhash.xxh64_intdigest(b"x y", 42)]


def test_crowded_buckets_lose_no_link(spark):
    """Random prints near two centres: the split of crowded buckets against all pairs."""
    rng, prints = random.Random(3), {}
    for i in range(400):
        p = rng.choice((0x0123456789ABCDEF, 0xFEDCBA9876543210))
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        prints[i] = p
    distinct = {p: i for i, p in reversed(prints.items())}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in distinct], "fp long")
    for bucket in (4, 10**6):
        root = {r.node: r.root for r in components(simhash.links(df, bucket)).collect()}
        groups = defaultdict(set)
        for p in distinct:
            groups[root.get(signed(p), signed(p))].add(p)
        want = defaultdict(set)
        for p, c in zip(distinct, linked({i: p for p, i in distinct.items()}), strict=True):
            want[c].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_equals_brute_force(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = decontaminate.brute_force(small, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op7_decontamination"](spark, DATA).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("block_words", [10**6, 5])
def test_decontamination_cases(spark, block_words):
    long = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {long} y"), (2, "Tiny item here"), (3, None), (4, ""), (5, f"{long[:-3]}"), (6, "aa aa aa aa"), (6, "aa aa aa aa"), (None, "tiny,ITEM"), (8, "été tiny-item")]
    items = [(10, long), (9, "tiny item"), (9, "tiny item"), (7, None), (6, " .. "), (5, "aa aa"), (None, "x w0")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    rows = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in got.collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(0, 2, 2, 1, True, sha("9")), (1, 22, 21, 1, True, sha("10")), (2, 3, 2, 1, True, sha("9")), (3, 0, 0, 0, False, sha("")), (4, 0, 0, 0, False, sha("")), (5, 19, 19, 1, True, sha("10")), (6, 4, 4, 1, True, sha("5")), (6, 4, 4, 1, True, sha("5")), (8, 3, 2, 1, True, sha("9"))]
    assert rows == want
    none = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("n_hit > 0 or contaminated").count() == 0 and none.count() == len(docs)


def test_long_items_come_in_slices(spark, monkeypatch):
    """Slices and blocks of a few words against brute force over the whole item."""
    rng = random.Random(12)
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 7)
    item = [f"w{rng.randrange(40)}" for _ in range(120)]
    items = [(1, " ".join(item)), (2, "w1 w2 w3"), (3, "w1 w2"), (4, " ".join(item[20:60]))]
    docs = [(i, " ".join(item[a : a + rng.randint(2, 30)] + ["x"] + rng.choices(item, k=10))) for i, a in enumerate(rng.randrange(110) for _ in range(40))]
    want = decontaminate.brute_force(docs, items, 4)
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 40):
        got = decontaminate.decontaminate(*tables, window=4, block_words=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def brute_spans(text: str) -> list[tuple]:
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def test_op5_equals_brute_force(spark, small):
    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, DATA).collect()}
    for i, text in small:
        want = brute_spans(text or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_base_spans_fuzzed():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+- (0255)b") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("bob at mail dot example dot com!", "email", "bob at mail dot example dot com"),
        ("to ｂｏｂ＠ｅｘ．ｃｏｍ", "email", "ｂｏｂ＠ｅｘ．ｃｏｍ"),
        ("é bоb@ex.com", "email", "bоb@ex.com"),
        ("call plus four nine one seven six five five five one two three four", "phone", "plus four nine one seven six five five five one two three four"),
    ],
)
def test_disguises_map_back(text, kind, span):
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, base)] == [(kind, span)] or (kind, span) in [(k, text[a:b]) for k, a, b in [*base, *pii.added_spans(text, base)]]
    assert span not in pii.redacted(text, [*base, *pii.added_spans(text, base)])


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus four 4 two 0 seven 9 four 6 zero 9 five 8 now", "phone", "plus four 4 two 0 seven 9 four 6 zero 9 five 8"),
        ("call +1 555 five five five 0123 now", "phone", "+1 555 five five five 0123"),
        ("call plus 1 555 five five five 0123; 2024 copies", "phone", "plus 1 555 five five five 0123"),
        ("pay 4111 1111 1111 one one one one.", "card", "4111 1111 1111 one one one one"),
        ("pay 4111, 1111, one one one one, 1111.", "card", "4111, 1111, one one one one, 1111"),
        ("host one two seven dot zero dot zero dot one up", "ip", "one two seven dot zero dot zero dot one"),
        ("call +1 555 five five five 0123 ones", "phone", "+1 555 five five five 0123"),
        ("host 127.zero.zero.one up", "ip", "127.zero.zero.one"),
        ("host 10 dot 0 dot 0 dot seven up", "ip", "10 dot 0 dot 0 dot seven"),
    ],
)
def test_partly_spelled_identifiers(text, kind, span):
    base = pii.base_spans(text)
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.added_spans(text, base)]
    assert span not in pii.redacted(text, [*base, *pii.added_spans(text, base)])


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("joe [аt] example [dot] com", "email", "joe [аt] example [dot] com"),
        ("joe [at] example [dоt] com", "email", "joe [at] example [dоt] com"),
        ("jоe at exаmple dot com. And", "email", "jоe at exаmple dot com"),
        ("mail joe dot smith at example dot co dot uk", "email", "joe dot smith at example dot co dot uk"),
        ("card: four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("host １２７ dot zero [dot] zerо dot one", "ip", "１２７ dot zero [dot] zerо dot one"),
    ],
)
def test_mixed_disguises_compose(text, kind, span):
    base = pii.base_spans(text)
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.added_spans(text, base)]


JUNK = {
    "blanks before a sign": lambda n: " " * n + " dot ", "blanks between": lambda n: "a" + " " * n + "dot b", "brackets": lambda n: "[ " * (n // 3), "at signs": lambda n: " at" * (n // 5),
    "blanks in a run": lambda n: "1" + " " * n + "one", "dots": lambda n: "x dot " * (n // 50), "addresses": lambda n: "a at b dot com " * (n // 50), "spelled": lambda n: "one " * (n // 25),
}


@pytest.mark.parametrize("kind", JUNK)
def test_time_is_linear(kind):
    """Eight times the text takes about eight times as long, where the square would take 64 times."""
    took = []
    for text in (JUNK[kind](125_000), JUNK[kind](1_000_000)):
        began = time.process_time()
        pii.added_spans(text, pii.base_spans(text))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.2)


def test_pii_cases(odd):
    rows = pii.find(odd, redact=True).collect()
    assert len(rows) == odd.count() and all(r.spans is not None and len(r.base_sha256) == 64 for r in rows)
    assert [r.redacted for r in rows if r.text is None] == [None] and all(r.redacted == r.text for r in rows if r.text is not None)
    assert pii.find(odd.limit(0)).count() == 0


def test_op6_cases(odd):
    rows = simhash.near_duplicates(odd, 3).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    # Null, empty and blank texts have print zero and are linked; the null id has its own group.
    assert {by[i].component_id for i in (2, 4, 5)} == {2} and by[2].fingerprint == "0" * 16
    assert by[1].component_id == 1 and by[None].component_id is None
    assert simhash.near_duplicates(odd.limit(0), 3).count() == 0


def test_hashes_in_chunks():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab A\n\t é") for _ in range(rng.randint(0, 60)))
        for size in (1, 3, 5):
            whole = simhash.shingle_hashes(text, size)
            assert all([h for c in simhash.hash_chunks(text, size, n) for h in c] == whole for n in (1, 7, 40))
            assert simhash.fingerprint(text, size) == simhash.fingerprint_of(whole)


def test_gate_never_shuts_out_a_span(monkeypatch):
    """Random mixes of words, numerals and separators: the gate against no gate."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["one", "Two", "zero", "7", "10", "4111", "plus", "+", "at", "dot", "a", "x"]) + rng.choice([" ", " ", ", ", ".", "-", " dot ", "[dot]", " (", "\t"]) for _ in range(rng.randint(4, 22))) for _ in range(6000)]
    gated = [pii.added_spans(t, pii.base_spans(t)) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert gated == [pii.added_spans(t, pii.base_spans(t)) for t in texts] and sum(map(bool, gated)) > 50


@pytest.mark.parametrize("text", ["look at the dot product", "we met at home. One two three.", "a at b", "абв text"])
def test_clean_text_stays_clean(text):
    assert pii.base_spans(text) + pii.added_spans(text, []) == []


def test_redaction_merges_overlaps():
    assert pii.redacted("x 1.2.3.4 y", [("ip", 2, 9), ("card", 4, 9)]) == "x [IP] y"


def test_op9_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op9_topk"](spark, DATA).collect())
    assert got == sorted(con.execute(ORACLES["op9_topk"]).fetchall())


def test_topk_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 40), (2003, [float("inf")] + [0.0] * 39), (None, rows[0][1]), (2100, [1.0, 2.0]), (2101, [3.0, 4.0]), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q, qv in whole.items():
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(qv)))[:10]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    for block in (2048, 2):
        got = {tuple(r) for r in topk.top_k(df, lambda i: i % 100 == 0, query_block=block).collect()}
        assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0


def test_topk_prunes_but_keeps_ties():
    ids, x = np.arange(50), np.ones((50, 64))
    found = [[]]
    topk.search_block(topk._prepared([(99, np.ones(64))]), [64.0], ids, x, found, 10)
    assert found[0] == [(64, i) for i in range(10)]


def test_op10_holds_its_law(spark, small):
    rows = QUERIES["op10_sharding"](spark, DATA).collect()
    text = dict(small)
    assert len(rows) == len(small)
    by_shard, shards_of = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
        shards_of[text[r.doc_id]].add(r.shard)
    assert set(by_shard) <= set(range(40)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    share, bytes_of = -(-sum(r.size for r in rows) // 40), defaultdict(int)
    for r in rows:
        bytes_of[text[r.doc_id]] += r.size
    # Only groups larger than a shard's share are split.
    assert all(len(s) == 1 for t, s in shards_of.items() if bytes_of[t] <= share)
    sizes = [sum(r.size for r in v) for v in by_shard.values()]
    assert max(sizes) <= 1.02 * max(sum(sizes) / 40, max(r.size for r in rows))


def test_sharding_splits_what_no_shard_holds(spark, odd):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"other {i}") for i in range(100)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10, whole=False)
    sizes = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * min(sizes)
    kept = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert kept.filter("doc_id < 1000").select("shard").distinct().count() == 1 and kept.select("shard").distinct().count() <= 10
    # Repeated rows, alike in all columns, are dealt too.
    same = sharding.shard_by_bytes(spark.createDataFrame([(1, "x")] * 1000, "doc_id long, text string"), 4, whole=False).groupBy("shard").agg(F.sum("size"), F.count("*"), F.max("slot")).collect()
    assert len(same) == 4 and max(r[1] for r in same) < 1.3 * min(r[1] for r in same) and all(r[3] == r[2] - 1 for r in same)
    got = sharding.shard_by_bytes(odd, 3)
    assert got.count() == odd.count() and got.filter("text_crc32 is null").count() == 1 and got.filter("shard is null or slot is null").count() == 0
    assert sharding.shard_by_bytes(odd.limit(0), 3).count() == 0


def test_runs_are_the_packing_of_single_items(spark, monkeypatch):
    """Against best fit one by one, with a list for the tree, and groups ranked in many parts."""
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 3, 5, 7, 11, 13)) for _ in range(rng.randint(1, 60))]
        capacity, room, want = rng.randint(13, 60), [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            room[b] -= sizes[i]
            want.append((i, b))
        assert sharding.best_fit_decreasing(sizes, capacity, len(room)) == [b for _, b in sorted(want)]
        assert sharding.best_fit_decreasing(sizes, capacity, len(room) - 1) is None
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    rows = spark.createDataFrame([(i, f"text {i % 200:03}") for i in range(600)], "doc_id long, text string")
    out = sharding.shard_by_bytes(rows, 7).collect()
    by_group = defaultdict(set)
    for r in out:
        by_group[r.group_key].add(r.shard)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    assert len(out) == 600 and all(len(s) == 1 for s in by_group.values())
    # 200 groups of 72 bytes in 7 bins: the least capacity holds 29 of them.
    assert max(sizes.values()) == 29 * 72
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_size_classes(spark):
    sizes = [1, 17, 65535, 65536, 65537, 65568, 100_001, 10**9 + 1, 2**40 - 1, 2**40]
    rows = [(r[0], r[1]) for r in spark.createDataFrame([(s,) for s in sizes], "s long").select("s", sharding.size_class(F.col("s"))).collect()]
    assert all(c == s for s, c in rows if s <= 65536) and all(s <= c <= s * (1 + 2**-9) for s, c in rows)


def test_best_fit_decreasing():
    sizes = [7, 6, 5, 4, 3, 3, 2]
    bins = sharding.best_fit_decreasing(sizes, 10, 3)
    assert bins is not None and max(sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(3)) <= 10
    assert sharding.best_fit_decreasing([6, 6, 6], 10, 2) is None and sharding.pack([], 3) == []
    tree, keys, rng = sharding.FreeSpace(), [], random.Random(0)
    for _ in range(2000):
        if keys and rng.random() < 0.4:
            k = keys.pop(rng.randrange(len(keys)))
            tree.remove(k)
        else:
            k = (rng.randrange(1000), rng.randrange(10**6))
            keys.append(k)
            tree.add(k)
        q = rng.randrange(1000)
        assert tree.tightest(q) == min((k for k in keys if k[0] >= q), default=None)


# -- pieces --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def all_segmentations(text: bytes, v) -> dict[tuple, float]:
    ids = {b: i for i, b in v.bytes_of.items() if i > 258}
    out = {}

    def walk(p, acc, w):
        if p == len(text):
            out[tuple(acc)] = np.exp(w)
            return
        for n in range(1, v.longest + 1):
            if p + n <= len(text) and text[p : p + n] in ids:
                walk(p + n, [*acc, ids[text[p : p + n]]], w + v.weight[ids[text[p : p + n]]])
        n = int(pieces.CHAR_BYTES[text[p]])
        if text[p : p + n] not in ids:
            some = [int(v.byte_ids[b]) for b in text[p : p + n]]
            walk(p + n, acc + some, w + sum(v.weight[i] for i in some))

    walk(0, [], 0.0)
    z = sum(out.values())
    return {k: w / z for k, w in out.items()}


@pytest.mark.parametrize("text", ["hello", " thé a▁b", "to\nbe  ", "\U0001f40d\U0001f40dx"])
def test_draws_follow_the_distribution(vocabulary, text):
    v, n = pieces.load(theta=0.3), 8000
    want = all_segmentations(text.encode(), v)
    got = defaultdict(int)
    for ids in pieces.encode_batch([text.encode()] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), v):
        got[tuple(ids.tolist())] += 1
    assert set(got) <= set(want) and sum(abs(got[k] / n - p) for k, p in want.items()) / 2 < 0.03


def test_encoding_is_reproducible_and_lossless(spark, small, vocabulary, odd):
    df = spark.createDataFrame(small, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    a = pieces.encode(df.repartition(3), keep=["doc_id", "text"])
    b = pieces.encode(df.repartition(7), keep=["doc_id", "text"])
    key = lambda r: (str(r.doc_id), r.text or "", str(r.piece_ids))
    ra, rb = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert ra == rb
    back = pieces.decode(a)
    assert back.filter("not (text <=> decoded)").count() == 0 and back.count() == df.count()
    other = pieces.encode(df, seed=1, keep=["doc_id", "text"]).collect()
    assert sorted(other, key=key) != ra
    sums = {(r.doc_id, r.n_pieces, r.ids_crc32, r.lossless) for r in pieces.digest(df, keep=["doc_id"]).collect()}
    assert sums == {(r.doc_id, len(r.piece_ids or []), binascii.crc32(np.array(r.piece_ids or [], dtype="<i4").tobytes()), True) for r in ra}


def test_chunks_cuts_and_windows_change_no_draw(vocabulary, monkeypatch):
    rng = random.Random(1)
    texts = [b"hello world foo bar " * 30, "thé a▁b \n\n x".encode() * 20, b"a" * 900 + b" bb", bytes(rng.choice(b"abcdefXYZ+/") for _ in range(2000)), "你好ꙮ".encode() * 300, b"", b"  \n "]
    seeds = np.arange(len(texts), dtype=np.uint64) * np.uint64(7919)
    draw = lambda: [x.tolist() for x in pieces.Encoder(vocabulary)(texts, seeds)]
    want = draw()
    assert all(pieces.lossless(t, np.array(i, dtype=np.int32), vocabulary, 7) for t, i in zip(texts, want, strict=True))
    assert not pieces.lossless(b"hello", np.array(want[0], dtype=np.int32), vocabulary)
    for values in ({"LONG": 10}, {"CHUNK": 50}, {"LONG": 3, "GIANT": 3, "WINDOW": 7}, {"CHUNK": 64, "LONG": 20, "GIANT": 40, "WINDOW": 16}):
        with monkeypatch.context() as m:
            for name, value in values.items():
                m.setattr(pieces, name, value)
            assert draw() == want


def test_a_blob_takes_bounded_memory(vocabulary):
    import tracemalloc

    rng = random.Random(2)
    blob = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(400_000))
    tracemalloc.start()
    ids = pieces.Encoder(vocabulary)([blob], np.zeros(1, dtype=np.uint64))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces.lossless(blob, ids, vocabulary) and peak < 200 * len(blob)

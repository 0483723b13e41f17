"""The pipeline end to end, each stage against what it promises."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import decontaminate, neardup, pii, pieces

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding"]
    after = []
    for name, stage in corpus_pipeline.STAGES:
        from corpusgraph.llm.common import cut

        docs = cut(stage(spark, docs, DATA), "stage")
        after.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    langs, near, clean, safe, tokens = after
    assert len(langs) == len(held)
    # Brute force: every pair of what the first stage kept.
    sets = {i: set(neardup.shingle_hashes(r.text, 5)) for i, r in langs.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert set(near) == set(root.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    dirty = decontaminate.brute_force([(i, r.text) for i, r in near.items()], items)
    # All benchmark items are longer than a window, so every hit is a whole window.
    assert set(clean) == {i for i, d in dirty.items() if not d[1]}
    for i, r in safe.items():
        text = clean[i].text
        assert r.text == pii.redacted(text, [*(b := pii.base_spans(text)), *pii.added_spans(text, b)]) and r.n_chars == len(r.text)
    v = pieces.load()
    assert {i: pieces.decode_ids(r.piece_ids, v).decode() for i, r in tokens.items()} == {i: r.text for i, r in safe.items()}
    assert all(r.n_pieces == len(r.piece_ids) for r in tokens.values())


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "A text.\n\nÉ \U0001f40d"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.lossless for r in corpus_pipeline.tokens(spark, docs, DATA).collect()] == [True] * 3


CLASHING = ("score", "ambiguous", "n_words", "hit_ranges", "spans", "redacted", "piece_ids", "__user0", "row", "node", "i", "fp")


def test_stages_take_odd_tables_and_clashing_names(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"user's {c}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        last = name == corpus_pipeline.STAGES[-1][0]
        kept = [c for c in docs.columns if not (last and c in ("text", "piece_ids"))]
        assert (out.columns == docs.columns) or (last and out.columns[: len(kept)] == kept)
        rows = out.collect()
        assert rows and all(r[c] == f"user's {c}" for r in rows for c in CLASHING if c in kept)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    langs = {r.doc_id for r in corpus_pipeline.language(spark, docs, DATA).collect()}
    assert not langs & {2, 4, 5, 8} and langs
    # Of repeated rows and of null and empty texts one row stays.
    near = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()]
    assert near.count(1) == 1 and set(near) <= {r.doc_id for r in odd.collect()}


def test_a_passage_in_a_long_text_goes(spark):
    """A window of 13 words among 2,000 is a leak; twelve of them aren't."""
    item = next(r.text.split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    filler = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join([*filler[:900], *item[:n], *filler[900:]])
    docs = spark.createDataFrame([(1, text(13)), (2, text(12)), (3, text(0)), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()} == {2, 3, 4}

"""Lexical and vector search, rank fusion, packing and the hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions.text import tokens
from corpusgraph.operators import lexical, memory, ranking, vector
from corpusgraph.plans.index import indexed
from corpusgraph.plans.lineage import written
from corpusgraph.plans.search import hybrid
from corpusgraph.queries.registry import PATH_SQL, TOKENS_SQL, query, table

AS_OF = "2024-02-01 00:00:00"
PHRASES = [["the"], ["of", "the"], ["and"], ["des"]]
TERMS = [["the"], ["und"], ["para"]]


@query("tokenize_explode", f"SELECT doc_id AS id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS t FROM documents) GROUP BY ALL")
def tokenize_explode(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", ["text"]).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("bm25_stats", f"WITH t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS ts FROM documents) SELECT count(*) AS n_rows, round(avg(len(ts)), 6) AS avg_len, count(*) FILTER (list_contains(ts, 'the')) AS df_the, count(*) FILTER (list_contains(ts, 'und')) AS df_und FROM t")
def bm25_stats(spark, d):
    t = table(spark, d, "documents").select(tokens(F.col("text")).alias("ts"))
    has = lambda w: F.count_if(F.array_contains("ts", w))
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.size("ts")), 6).alias("avg_len"), has("the").alias("df_the"), has("und").alias("df_und"))


def bm25_sql(phrases: list[list[str]], limit: int) -> str:
    """BM25 written out; a phrase is a run of consecutive tokens."""
    hits = []
    for k, p in enumerate(phrases):
        test = " AND ".join(f"ts[i + {j}] = '{t}'" for j, t in enumerate(p))
        hits.append(f"SELECT doc_id, dl, {k} AS ph, len(list_filter(range(1, CAST(dl AS BIGINT) - {len(p) - 2}), lambda i: {test})) AS tf FROM t")
    return f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS ts, CAST(len({TOKENS_SQL.format('text')}) AS DOUBLE) AS dl FROM documents),
h AS ({' UNION ALL '.join(hits)}),
c AS (SELECT count(*) AS nr, avg(dl) AS av FROM t),
dfs AS (SELECT ph, count(*) FILTER (tf > 0) AS df FROM h GROUP BY ph),
s AS (SELECT doc_id, sum(CASE WHEN ln((nr - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((nr - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score, sum(tf) AS hits FROM h JOIN dfs USING (ph), c GROUP BY doc_id)
SELECT doc_id AS id, round(score, 6) AS score FROM s WHERE hits > 0 ORDER BY s.score DESC, id LIMIT {limit}"""


def ranked_documents(spark, d, phrases, limit=80):
    """BM25 over all documents, from an index that the session makes once."""
    return lexical.bm25(*indexed(spark, f"{d}/documents.parquet", "doc_id", ("text",)), phrases, limit)


@query("bm25_topk", bm25_sql(TERMS, 80))
def bm25_topk(spark, d):
    return ranked_documents(spark, d, TERMS).select("id", F.round("score", 6).alias("score"))


@query("bm25_phrase", bm25_sql(PHRASES, 80))
def bm25_phrase(spark, d):
    return ranked_documents(spark, d, PHRASES).select("id", F.round("score", 6).alias("score"))


@query("bm25_scan", bm25_sql(PHRASES, 80))
def bm25_scan(spark, d):
    # Rows that no index has yet are ranked from their texts in one pass and a one-row aggregate.
    hits = written(lexical.scanned(table(spark, d, "documents"), "doc_id", ["text"], PHRASES), "hits")
    return lexical.scored(hits, lexical.totals(hits), len(PHRASES), 80).select("id", F.round("score", 6).alias("score"))


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


KNN_SQL = "SELECT vec_id, round(similarity, 5) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY similarity DESC, vec_id DESC LIMIT 20"


@query("knn_cosine", KNN_SQL)
def knn_cosine(spark, d):
    return vector.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", query_vector(spark, d)).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("embedding_dims", "SELECT count(DISTINCT len(embedding)) AS n_dims, min(len(embedding)) AS dim, count(*) AS n_valid FROM embeddings WHERE len(embedding) > 0")
def embedding_dims(spark, d):
    e = table(spark, d, "embeddings").filter(vector.valid(F.col("embedding"))).withColumn("n", F.size("embedding"))
    return e.agg(F.countDistinct("n").alias("n_dims"), F.min("n").cast("long").alias("dim"), F.count(F.lit(1)).alias("n_valid"))


@query("embed_cache_split", "SELECT doc_id, EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND sha256(c.text) = sha256(d.text)) AS hit FROM documents d")
def embed_cache_split(spark, d):
    wanted = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    cache = wanted.filter("doc_id % 3 = 0").select("digest").distinct()
    hit, miss = vector.cache_split(wanted, cache, ["digest"])
    return hit.select("doc_id", F.lit(True).alias("hit")).unionByName(miss.select("doc_id", F.lit(False).alias("hit")))


EMBED_SQL = r"""
WITH w AS (SELECT item_id, sha256(unnest(string_split_regex(trim(lower(text)), '\s+'))) AS x FROM benchmark WHERE trim(text) <> ''),
s AS (SELECT item_id, CAST('0x' || substr(x, 1, 2) AS INTEGER) % 16 AS k, sum(CASE WHEN CAST('0x' || substr(x, 3, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(v * v)) AS size FROM s GROUP BY 1)
SELECT b.item_id, round(CAST(CAST(coalesce(s.v, 0) / CASE WHEN coalesce(n.size, 0) = 0 THEN 1 ELSE n.size END AS FLOAT) AS DOUBLE), 5) AS v1, 16 AS dim
FROM benchmark b LEFT JOIN s ON s.item_id = b.item_id AND s.k = 0 LEFT JOIN n ON n.item_id = b.item_id"""


@query("embed_hash", EMBED_SQL)
def embed_hash(spark, d):
    return table(spark, d, "benchmark").select("item_id", vector.hash_embedder()(F.col("text")).alias("v")).select("item_id", F.round(F.element_at("v", 1).cast("double"), 5).alias("v1"), F.size("v").alias("dim"))


# Lexical and semantic ranks over documents and vectors that share their ids.
def seeds(spark, d):
    lex = ranking.ranks(ranked_documents(spark, d, TERMS)).select(F.lit("fts").alias("source"), "id", "rank")
    near = vector.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", query_vector(spark, d))
    sem = ranking.ranks(near.select(F.col("vec_id").alias("id"), F.round("similarity", 9).alias("score"))).select(F.lit("semantic").alias("source"), "id", "rank")
    exact = spark.createDataFrame([("exact", 7, 1)], "source string, id long, rank int")
    return [lex, sem, exact]


SEEDS_SQL = f"""
lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({bm25_sql(TERMS, 80).replace('round(score, 6) AS score', 'score')})),
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM ({KNN_SQL.replace('round(similarity, 5) AS similarity', 'similarity')})),
shares AS (SELECT 'fts' AS source, id, 1.0 / CAST(60 + rank AS DOUBLE) AS share FROM lex UNION ALL SELECT 'semantic', id, 1.0 / CAST(60 + rank AS DOUBLE) FROM sem UNION ALL SELECT 'exact', 7, 1.0)"""


@query("rrf_fuse", f"WITH {SEEDS_SQL} SELECT id, round(sum(share), 9) AS score, arg_max(source, (share, source)) AS via FROM shares GROUP BY id")
def rrf_fuse(spark, d):
    rows = seeds(spark, d)
    return ranking.fuse(rows[0].unionByName(rows[1]).unionByName(rows[2])).select("id", F.round("score", 9).alias("score"), "via")


@query("recency_decay", f"SELECT event_id, round((0.85 + 0.15 * exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0 / 30.0)) * CASE WHEN user_id % 10 = 0 THEN 1.25 ELSE 1 END * CASE WHEN event_id % 4 = 0 THEN 0.8 ELSE 1 END, 9) AS score FROM events")
def recency_decay(spark, d):
    score = ranking.recency(F.lit(1.0), F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    state = F.when(F.col("event_id") % 4 == 0, "stale").otherwise("fresh")
    return table(spark, d, "events").select("event_id", F.round(ranking.multiplied(score, F.col("user_id") % 10 == 0, state), 9).alias("score"))


@query("zoom_render", f"SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN {PATH_SQL} || ': ' || source WHEN 1 THEN CASE WHEN lang = 'en' THEN split_part(text, chr(10), 1) ELSE left(text, 600) END WHEN 2 THEN text ELSE CASE WHEN lang = 'en' THEN text ELSE left(text, 600) END END) AS content_sha FROM documents")
def zoom_render(spark, d):
    from corpusgraph.queries.registry import path_of

    level = F.element_at(F.array(F.lit("L0"), F.lit("L1"), F.lit("L2"), F.lit("auto")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.sha2(ranking.zoomed(level, path_of(), F.col("source"), F.col("text"), F.col("lang") == "en"), 256).alias("content_sha"))


@query("auto_zoom", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > greatest(800, 4000 // 3) THEN 'L1' ELSE 'L2' END AS zoom FROM documents")
def auto_zoom(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") > ranking.quota(4000, F.lit(3)), "L1").otherwise("L2").alias("zoom"))


@query("pack_prefix", f"SELECT id, rank, size, running FROM (SELECT *, CAST(sum(size) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT b.id, row_number() OVER (ORDER BY b.score DESC, b.id) AS rank, CAST(octet_length(encode(left(text, 600))) AS BIGINT) AS size FROM ({bm25_sql(TERMS, 80).replace('round(score, 6) AS score', 'score')}) b JOIN documents ON doc_id = b.id)) WHERE running <= 16000")
def pack_prefix(spark, d):
    docs = table(spark, d, "documents")
    found = ranking.ranks(ranked_documents(spark, d, TERMS)).join(docs.select(F.col("doc_id").alias("id"), F.octet_length(F.substring("text", 1, 600)).cast("long").alias("size")), "id")
    return ranking.pack_prefix(found.select("id", "rank", "size"), 16000)


@query("pack_exact")
def pack_exact(spark, d):
    docs = table(spark, d, "documents")
    found = ranking.ranks(ranked_documents(spark, d, TERMS)).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = found.orderBy("rank").select("id", "rank", "text").collect()  # at most 80 rows behind the top-k
    out = ranking.pack([{"id": r[0], "rank": r[1], "content": r[2]} for r in rows], 4000, mode="fts")
    return spark.createDataFrame([(i["id"], i["rank"], len(i["content"]), bool(i.get("truncated"))) for i in out["items"]], "id long, rank int, n_chars int, truncated boolean")


@query("memory_current", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def memory_current(spark, d):
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "role", "text")
    return memory.current(log).select(F.col("id").alias("conv_id"), F.col("seq").alias("turn"), "role", "text")


@query("memory_set_state", "SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'retracted' ELSE 'fresh' END AS state FROM conversations WHERE turn = 0")
def memory_set_state(spark, d):
    log = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.lit("fresh").alias("state"))
    return memory.set_state(log, log.filter("id % 5 = 0").select("id"), "retracted")


HYBRID_SQL = f"""
WITH RECURSIVE {SEEDS_SQL},
nodes AS (SELECT doc_id AS id, TIMESTAMP '{AS_OF}' - CAST(doc_id % 60 AS INTEGER) * INTERVAL 1 DAY AS updated_at, doc_id % 17 = 0 AS pinned, CASE WHEN doc_id % 4 = 1 THEN 'stale' ELSE 'fresh' END AS state FROM documents WHERE doc_id % 13 <> 5),
edges AS (SELECT d.doc_id AS src, d.doc_id + 1 AS dst, CASE WHEN d.doc_id % 2 = 0 THEN 0.8 ELSE 0.6 END AS weight FROM documents d WHERE d.doc_id % 13 <> 5 AND (d.doc_id + 1) % 13 <> 5 AND d.doc_id + 1 <= (SELECT max(doc_id) FROM documents)),
both_ways AS (SELECT src AS a, dst AS b, CAST(weight AS DOUBLE) AS w FROM edges UNION ALL SELECT dst, src, CAST(weight AS DOUBLE) FROM edges),
ok AS (SELECT s.* FROM shares s JOIN nodes n ON n.id = s.id),
firsts AS (SELECT id, sum(share) AS score FROM ok GROUP BY id),
s0 AS (SELECT id, score FROM firsts ORDER BY score DESC, id LIMIT 8),
s1 AS (SELECT b AS id, max(score * w * 0.6) AS score FROM s0 JOIN both_ways ON a = id WHERE score * w * 0.6 >= 0.001 GROUP BY b),
s2 AS (SELECT b AS id, max(score * w * 0.6) AS score FROM s1 JOIN both_ways ON a = id WHERE score * w * 0.6 >= 0.001 GROUP BY b),
reached AS (SELECT id, max(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 80),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM reached),
total AS (SELECT id, sum(share) AS score, arg_max(source, (share, source)) AS via FROM (SELECT source, id, share FROM ok UNION ALL SELECT 'structural', id, 0.7 / CAST(60 + rank AS DOUBLE) FROM ranked) GROUP BY id)
SELECT id, round(score * (0.85 + 0.15 * exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0 / 30.0)) * CASE WHEN pinned THEN 1.25 ELSE 1 END * CASE WHEN state = 'stale' THEN 0.8 ELSE 1 END, 8) AS score, via
FROM total JOIN nodes USING (id)"""


@query("search_hybrid", HYBRID_SQL)
def search_hybrid(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    nodes = docs.select(
        i.alias("id"), F.timestamp_add("DAY", -(i % 60).cast("int"), F.lit(AS_OF).cast("timestamp")).alias("updated_at"), (i % 17 == 0).alias("pinned"),
        F.when(i % 4 == 1, "stale").otherwise("fresh").alias("state"), (i % 13 != 5).alias("allowed"),
    )
    edges = docs.select(i.alias("src"), (i + 1).alias("dst"), F.lit("calls").alias("kind"), F.when(i % 2 == 0, 0.8).otherwise(0.6).alias("weight"))
    return hybrid(seeds(spark, d), edges, nodes, AS_OF).select("id", F.round("score", 8).alias("score"), "via")

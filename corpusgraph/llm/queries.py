"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.llm.common import table


def op1_licences(spark, sf_dir):
    from corpusgraph.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_quality(spark, sf_dir):
    from corpusgraph.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), keep=["doc_id"])


# Fixed values of the example: dated list entries (list, action, pattern, date, listed).
URL_LIST = """
  ('adult', 'block', 'adult-x.example.net', '2024-01-01', true),
  ('adult', 'block', 'adult-x.example.net', '2024-06-01', false),
  ('adult', 'block', 'adult-x.example.net', '2024-09-15', true),
  ('ads', 'block', 'ads-track.example.com', '2024-01-15', true),
  ('ads', 'block', 'ads-track.example.com', '2024-02-15', false),
  ('ads', 'block', 'ads-track.example.com', '2024-08-01', true),
  ('gambling', 'block', 'casino-win.example.com', '2024-02-01', true),
  ('gambling', 'block', 'free-bets.example.com', '2024-03-10', true),
  ('gambling', 'block', 'free-bets.example.com', '2024-11-01', false),
  ('pharma', 'block', 'cheap-pills.example.com', '2024-04-01', true),
  ('spam', 'block', 'spam-farm.example.com', '2023-05-01', true),
  ('trusted', 'allow', 'blog.adult-x.example.net', '2024-10-01', true),
  ('regional', 'block', 'example.org/fr', '2024-05-01', true),
  ('regional', 'block', 'example.org/fr', '2024-05-31', false),
  ('partners', 'allow', 'ththan.example.org', '2024-05-10', true)
"""


def op3_urlfilter(spark, sf_dir):
    from corpusgraph.llm.urlfilter import judge

    entries = spark.sql(f"SELECT list, action, pattern, to_timestamp(dated) AS dated, listed FROM VALUES {URL_LIST} AS e(list, action, pattern, dated, listed)")
    # The table has no fetch times; a rule spreads the captures over the year.
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched"))
    return judge(captures, entries).select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "deciding_list", "deciding_pattern", "blocked")


OP3_SQL = f"""
WITH e(list, action, pattern, dated, listed) AS (VALUES {URL_LIST}),
iv AS (
  SELECT *, split_part(pattern, '/', 1) AS domain,
         CASE WHEN contains(pattern, '/') THEN substr(pattern, instr(pattern, '/')) ELSE '' END AS path,
         CAST(dated AS DATE) AS valid_from,
         coalesce(lead(CAST(dated AS DATE)) OVER (PARTITION BY list, action, pattern ORDER BY dated), DATE '9999-12-31') AS valid_until
  FROM e
), p AS (
  SELECT row_number() OVER () AS r, page_id,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path,
         DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS t
  FROM pages
), j AS (
  SELECT p.r, iv.list, iv.pattern, iv.action,
         row_number() OVER (PARTITION BY p.r ORDER BY length(iv.pattern) DESC, iv.action = 'block' DESC, iv.list, iv.pattern) AS k,
         count(*) OVER (PARTITION BY p.r) AS n
  FROM p JOIN iv ON iv.listed AND (p.host = iv.domain OR ends_with(p.host, '.' || iv.domain))
   AND iv.valid_from <= p.t AND p.t < iv.valid_until AND (iv.path = '' OR p.path = iv.path OR starts_with(p.path, iv.path || '/'))
)
SELECT p.page_id, p.host, strftime(p.t, '%Y-%m-%d') AS fetched, coalesce(j.n, 0) AS n_active,
       j.list AS deciding_list, j.pattern AS deciding_pattern, coalesce(j.action = 'block', false) AS blocked
FROM p LEFT JOIN j ON p.r = j.r AND j.k = 1
"""


def op4_langid(spark, sf_dir):
    from corpusgraph.llm.langid import held_out, identify

    return identify(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_pieces(spark, sf_dir):
    from corpusgraph.llm.pieces import digest

    return digest(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_topk(spark, sf_dir):
    from corpusgraph.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op10_sharding(spark, sf_dir):
    from corpusgraph.llm.sharding import shard_by_bytes

    # The law of near equal sizes holds at any size of the groups only if those beyond a share divide.
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40, whole=False)


def op5_pii(spark, sf_dir):
    from corpusgraph.llm.pii import find

    return find(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_decontamination(spark, sf_dir):
    from corpusgraph.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_simhash(spark, sf_dir):
    from corpusgraph.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


QUERIES = {"op1_licences": op1_licences, "op2_quality": op2_quality, "op3_urlfilter": op3_urlfilter, "op4_langid": op4_langid, "op5_pii": op5_pii, "op8_pieces": op8_pieces, "op9_topk": op9_topk, "op6_simhash": op6_simhash, "op7_decontamination": op7_decontamination, "op10_sharding": op10_sharding}
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
# Words are compared by their exact runs; a window of an item is a list of words.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, list_slice(ws, i, i + least(13, len(ws)) - 1) AS w FROM b, unnest(range(1, greatest(2, len(ws) - 11))) AS t(i) WHERE len(ws) > 0
), dw AS (
  SELECT r, i, n, list_slice(ws, i, i + n - 1) AS w FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS t(i) WHERE len(ws) >= n
), m AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r
), o AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)
"""
ORACLES: dict[str, str] = {"op3_urlfilter": OP3_SQL, "op7_decontamination": OP7_SQL, "op9_topk": OP9_SQL}

"""Scans, filters, projections and the ingest gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import gate, text
from corpusgraph.operators import parse
from corpusgraph.operators.lexical import query_tokens as split_query
from corpusgraph.operators.parse import parse_imports, parse_symbols
from corpusgraph.queries.registry import PATH_SQL, TOKENS_SQL, doc_files, query, table
from corpusgraph.sources.files import EXCLUDED, text_only


@query("lookup_pk", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def lookup_pk(spark, d):
    return table(spark, d, "documents").filter("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


@query("filter_conjunctive", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size = 10 AND p_retailprice > 950 ORDER BY p_partkey LIMIT 50")
def filter_conjunctive(spark, d):
    return table(spark, d, "part").filter((F.col("p_size") == 10) & (F.col("p_retailprice") > 950)).select("p_partkey", "p_brand", "p_size", "p_retailprice").orderBy("p_partkey").limit(50)


@query("isin_filter", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system')")
def isin_filter(spark, d):
    return table(spark, d, "conversations").filter(F.col("role").isin("user", "system")).select("conv_id", "turn", "role")


@query("json_extract_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_extract_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k > 50")


@query("array_contains_filter", "SELECT doc_id, source FROM documents WHERE list_contains([lang, source], 'src3') OR list_contains([lang, source], 'de')")
def array_contains_filter(spark, d):
    labels = F.array("lang", "source")
    return table(spark, d, "documents").filter(F.array_contains(labels, "src3") | F.array_contains(labels, "de")).select("doc_id", "source")


@query("case_projection", "SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN left(text, 1200) ELSE text END) AS indexed_sha FROM documents")
def case_projection(spark, d):
    indexed = F.when(F.col("lang") == "en", F.substring("text", 1, 1200)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(indexed, 256).alias("indexed_sha"))


@query("coalesce_location", f"SELECT doc_id, CASE WHEN lang = 'en' THEN {PATH_SQL} || '::' || source WHEN lang = 'de' THEN {PATH_SQL} ELSE source END AS location FROM documents")
def coalesce_location(spark, d):
    symbol, path = F.when(F.col("lang") == "en", F.col("source")), F.when(F.col("lang").isin("en", "de"), F.col("path"))
    return doc_files(spark, d).select("doc_id", F.coalesce(F.when(symbol.isNotNull(), F.concat_ws("::", path, symbol)), path, F.col("source")).alias("location"))


@query("preview_projection", "SELECT doc_id, left(text, 600) AS preview FROM documents")
def preview_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 600).alias("preview"))


@query("first_line", "SELECT doc_id, left(split_part(text, chr(10), 1), 200) AS signature FROM documents")
def first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_line(F.col("text")).alias("signature"))


@query("line_count", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM documents")
def line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query("scan_glob_filter", f"SELECT doc_id, {PATH_SQL} AS path FROM documents WHERE regexp_matches({PATH_SQL}, '^src1.*/.*\\.en$') AND NOT regexp_matches({PATH_SQL}, '^src1/.*$')")
def scan_glob_filter(spark, d):
    path = F.col("path")
    return doc_files(spark, d).filter(text.matches_glob(path, ["src1*/*.en"]) & ~text.matches_glob(path, [*EXCLUDED, "src1/*"])).select("doc_id", "path")


@query("scan_size_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND n_chars <= 2000")
def scan_size_filter(spark, d):
    return table(spark, d, "documents").filter("n_chars > 0 and n_chars <= 2000").select("doc_id", "n_chars")


@query("scan_text_filter", "SELECT page_id FROM pages WHERE NOT contains(left(html, 4096), chr(0))")
def scan_text_filter(spark, d):
    return text_only(table(spark, d, "pages").withColumn("raw", F.encode("html", "UTF-8")), "raw").select("page_id")


@query("content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS file_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("file_hash"))


COLLAPSED_SQL = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query("normalize_hash", f"SELECT doc_id, 'sha256:' || sha256({COLLAPSED_SQL}) AS span_hash FROM documents")
def normalize_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.span_hash(F.col("text")).alias("span_hash"))


@query("masked_hash", f"SELECT doc_id, 'sha256:' || sha256(regexp_replace({COLLAPSED_SQL}, '^[^ ]+', '<name>')) AS body_hash FROM documents")
def masked_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.masked_hash(F.col("text")).alias("body_hash"))


@query("ext_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'rust' END AS language FROM documents")
def ext_lookup(spark, d):
    suffix = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "go").when(F.col("lang") == "fr", "rs").otherwise(F.col("lang"))
    return doc_files(spark, d).select("doc_id", text.extension_language(F.concat(F.lit("a.b/"), F.col("source"), F.lit("."), suffix)).alias("language"))


# Names are a text's beginning with "Th" read as "Test"; one source's paths lie in a folder of tests.
@query("test_detection", f"SELECT doc_id, (source = 'src1' OR starts_with(text, 'Th') OR regexp_matches({PATH_SQL}, 'test_|_test\\.|/tests/|spec\\.') OR starts_with(text, 'Test') OR starts_with(text, 'test_')) AS is_test FROM documents")
def test_detection(spark, d):
    path = F.when(F.col("source") == "src1", F.concat(F.lit("a/tests/"), "path")).otherwise(F.col("path"))
    return doc_files(spark, d).select("doc_id", parse.names_a_test(path, F.regexp_replace("content", "^Th", "Test"), "python").alias("is_test"))


# The gate over documents whose paths are made to look like credentials for one source.
GATED_PATH_SQL = "CASE WHEN source = 'src4' THEN 'deploy/' || CAST(doc_id AS VARCHAR) || '.pem' WHEN source = 'src5' THEN '.aws/' || CAST(doc_id AS VARCHAR) ELSE " + PATH_SQL + " END"


def gated(spark, d):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("source") == "src4", F.concat(F.lit("deploy/"), n, F.lit(".pem"))).when(F.col("source") == "src5", F.concat(F.lit(".aws/"), n)).otherwise(F.col("path"))
    return doc_files(spark, d).withColumn("path", path)


@query("gate_path", f"SELECT doc_id, (regexp_matches({GATED_PATH_SQL}, '\\.pem$') OR regexp_matches({GATED_PATH_SQL}, '^\\.aws/')) AS secret FROM documents")
def gate_path(spark, d):
    return gated(spark, d).select("doc_id", gate.path_is_secret(F.col("path")).alias("secret"))


STRONG_SQL = "regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b|\\bgh[pousr]_[A-Za-z0-9]{20,}|\\bxox[baprs]-[A-Za-z0-9-]{10,}|\\bsk-[A-Za-z0-9_\\-]{20,}|\\bAIza[0-9A-Za-z_\\-]{30,}|\"type\"\\s*:\\s*\"service_account\"')"


@query("gate_strong", f"SELECT doc_id, {STRONG_SQL} AS secret FROM documents")
def gate_strong(spark, d):
    return table(spark, d, "documents").select("doc_id", gate.strong(F.col("text")).alias("secret"))


ASSIGNED_SQL = """
hits AS (
  SELECT doc_id, value FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])(?:secret|token|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)[ \\t\\f]*["'']?[ \\t\\f]*[:=][ \\t\\f]*["'']?([A-Za-z0-9+/=_\\-]{16,})', 1)) AS value
    FROM documents)
), chars AS (
  SELECT doc_id, value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT doc_id, value FROM hits)
), freq AS (
  SELECT doc_id, value, c, count(*) AS k FROM chars GROUP BY ALL
), rated AS (
  SELECT doc_id, value, -sum((k / CAST(length(value) AS DOUBLE)) * log2(k / CAST(length(value) AS DOUBLE))) AS bits FROM freq GROUP BY doc_id, value
)"""


@query("gate_entropy", f"WITH {ASSIGNED_SQL} SELECT h.doc_id, h.value, round(r.bits, 6) AS bits, r.bits >= 3.7 AS random FROM hits h JOIN rated r USING (doc_id, value)")
def gate_entropy(spark, d):
    hits = table(spark, d, "documents").select("doc_id", F.explode(gate.assigned(F.col("text"))).alias("value"))
    return hits.select("doc_id", "value", F.round(text.entropy(F.col("value")), 6).alias("bits"), gate.random_value(F.col("value"), 3.7).alias("random"))


LABEL_SQL = f"""
WITH {ASSIGNED_SQL}, random_docs AS (SELECT DISTINCT doc_id FROM rated WHERE bits >= 3.7)
SELECT d.doc_id, CASE WHEN regexp_matches({GATED_PATH_SQL}, '\\.pem$|^\\.aws/') OR {STRONG_SQL} OR r.doc_id IS NOT NULL THEN 'secret' ELSE 'repo:private' END AS label
FROM documents d LEFT JOIN random_docs r ON d.doc_id = r.doc_id"""


def labelled(spark, d):
    return gated(spark, d).withColumn("label", gate.label(F.col("path"), F.col("content"), least=3.7))


@query("gate_classify", LABEL_SQL.replace("doc_id AS VARCHAR", "d.doc_id AS VARCHAR"))
def gate_classify(spark, d):
    return labelled(spark, d).select("doc_id", "label")


@query("policy_filter", f"SELECT doc_id FROM ({LABEL_SQL.replace('doc_id AS VARCHAR', 'd.doc_id AS VARCHAR')}) WHERE label <> 'secret'")
def policy_filter(spark, d):
    return labelled(spark, d).filter(F.col("label") != gate.SECRET).select("doc_id")


@query(
    "gate_then_tokenize",
    f"SELECT l.doc_id, CAST(len({TOKENS_SQL.format('d.text')}) AS INTEGER) AS n_tokens FROM ({LABEL_SQL.replace('doc_id AS VARCHAR', 'd.doc_id AS VARCHAR')}) l JOIN documents d ON d.doc_id = l.doc_id WHERE l.label <> 'secret'",
)
def gate_then_tokenize(spark, d):
    return labelled(spark, d).filter(F.col("label") != gate.SECRET).select("doc_id", F.size(text.tokens(F.col("content"))).alias("n_tokens"))


@query("query_tokens", "SELECT * FROM (VALUES (1, 'TokenStore'), (2, 'verify_token'), (3, 'Token'), (4, 'Store'), (5, 'verify'), (6, 'token')) v(rank, token)")
def query_tokens(spark, d):
    return spark.createDataFrame(list(enumerate(split_query("TokenStore verify_token"), 1)), "rank int, token string")


@query("octet_budget", "SELECT doc_id, CAST(octet_length(encode('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')) AS INTEGER) AS bytes FROM documents")
def octet_budget(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length(F.to_json(F.struct("doc_id", "lang", "source"))).alias("bytes"))


@query("json_items", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS item FROM documents")
def json_items(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("item"))


# Source files for the parser, written from benchmark items by a rule.
def code_files(spark, d):
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +")
    w = lambda i: F.concat(F.lit("w_"), F.element_at(words, i))
    code = F.concat(F.lit("import os\nfrom . import base\n\nclass C"), F.col("item_id"), F.lit(":\n    def m_"), w(1), F.lit("(self):\n        "), w(2), F.lit("(1)\n        self."), w(3), F.lit("()\n\ndef test_"), w(2), F.lit("():\n    pass\n"))
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("pkg/f"), F.col("item_id"), F.lit(".py")).alias("path"), code.alias("content"))


CODE_SQL = """
w AS (
  SELECT item_id, 'pkg/f' || item_id || '.py' AS path, regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +') AS t FROM benchmark
)"""


@query("udtf_symbols", f"WITH {CODE_SQL} SELECT path, 'C' || item_id AS qualname, false AS is_test, 4 AS start_line FROM w UNION ALL SELECT path, 'C' || item_id || '.m_w_' || t[1], false, 5 FROM w UNION ALL SELECT path, 'test_w_' || t[2], true, 9 FROM w")
def udtf_symbols(spark, d):
    return parse_symbols(code_files(spark, d)).select("path", "qualname", "is_test", "start_line")


@query("udtf_calls", f"WITH {CODE_SQL} SELECT path, 'C' || item_id || '.m_w_' || t[1] AS qualname, array_to_string(list_sort(list_distinct(['w_' || t[2], 'w_' || t[3]])), ',') AS calls FROM w")
def udtf_calls(spark, d):
    return parse_symbols(code_files(spark, d)).filter(F.size("calls") > 0).select("path", "qualname", F.array_join("calls", ",").alias("calls"))


@query("udtf_imports", f"WITH {CODE_SQL} SELECT path, 0 AS statement_id, 'import os' AS statement FROM w UNION ALL SELECT path, 1, 'from . import base' FROM w")
def udtf_imports(spark, d):
    return parse_imports(code_files(spark, d)).select(F.col("src_path").alias("path"), "statement_id", "statement")

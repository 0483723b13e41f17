"""The decorator by which queries register, and the tables in their graph roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.schema import EDGE_WEIGHTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


PATH_SQL = "source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang"


def doc_files(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", path_of().alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


# The star schema as a graph: regions define nations, nations call suppliers and customers,
# customers import orders, nations are tested by their customers.
def star_edges(spark, sf_dir: str) -> DataFrame:
    nation, customer, supplier, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), F.lit(EDGE_WEIGHTS[kind]).alias("weight"))
    return (
        edge(nation, name("r", "n_regionkey"), name("n", "n_nationkey"), "defines")
        .unionByName(edge(supplier, name("s", "s_suppkey"), name("n", "s_nationkey"), "calls"))
        .unionByName(edge(customer, name("c", "c_custkey"), name("n", "c_nationkey"), "imports"))
        .unionByName(edge(orders, name("c", "o_custkey"), name("o", "o_orderkey"), "tested_by"))
    )


EDGES_SQL = """
edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'defines' AS kind, CAST(0.9 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'calls', CAST(0.8 AS DOUBLE) FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'imports', CAST(0.6 AS DOUBLE) FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'tested_by', CAST(0.85 AS DOUBLE) FROM orders
)"""


def star_nodes(spark, sf_dir: str) -> DataFrame:
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    node = lambda df, prefix, key, kind, name: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return (
        node(region, "r", "r_regionkey", "file", "r_name")
        .unionByName(node(nation, "n", "n_nationkey", "symbol", "n_name"))
        .unionByName(node(customer, "c", "c_custkey", "test", "c_name"))
        .unionByName(node(supplier, "s", "s_suppkey", "symbol", "s_name"))
    )


NODES_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, 'file' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'symbol', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'test', c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'symbol', s_name FROM supplier
)"""
FOLD_SQL = "strip_accents(lower({}))"
TOKENS_SQL = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"

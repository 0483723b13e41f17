"""Kinds, weights, limits and table schemas of the anchored graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of nodes, kinds of edges with their default weights, states, limits.
STRUCTURAL = ("repo", "module", "file", "symbol", "test", "config")
MEMORY = ("decision", "failure", "constraint", "convention", "correction", "task")
NODE_KINDS = (*STRUCTURAL, *MEMORY, "episode")
EDGE_WEIGHTS = {"defines": 0.9, "calls": 0.8, "imports": 0.6, "tested_by": 0.85, "configures": 0.7, "co_changed": 0.5, "about": 0.95, "caused_by": 0.9, "supersedes": 1.0, "contradicts": 0.0, "derived_from": 0.0}
STATES = ("fresh", "stale", "superseded", "retracted")
SPREAD_EDGES = ("calls", "defines", "tested_by", "imports", "about")
MAX_FANOUT = 8
AMBIGUOUS_CALL_WEIGHT = 0.4
MAX_FILE_BYTES = 400_000
PREVIEW_CHARS = 600
INDEXED_CHARS = 1200
LEXICAL_LIMIT, EXACT_LIMIT, SEMANTIC_LIMIT, SEEDS, SPREAD_LIMIT, NEIGHBOR_LIMIT, IMPACT_LIMIT = 80, 30, 20, 8, 80, 80, 200
SCHEMA_VERSION = 2

ANCHOR = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("span_hash", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("start_line", T.IntegerType())]
)
SYMBOLS = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("qualname", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("is_test", T.BooleanType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("signature", T.StringType()),
        T.StructField("body", T.StringType()), T.StructField("span_hash", T.StringType()), T.StructField("body_hash", T.StringType()), T.StructField("calls", T.ArrayType(T.StringType())),
    ]
)
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType())])

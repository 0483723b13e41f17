"""Inverted index and BM25 over words and phrases, as DataFrame plans.

An index is two tables, made when rows are written and read by every search: ``postings``, a row
for each token of a field with its positions, in ranges of tokens, and ``lengths``, a row for
each document. A search reads the row groups of its own tokens and touches no text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import tokens

K1, B = 1.2, 0.75


def query_tokens(query: str, most: int = 32) -> list[str]:
    """Identifiers, then camel-split terms, in order and distinct."""
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", query)
    return list(dict.fromkeys([*re.findall(r"\w+", query), *re.findall(r"[^\W_]+", spaced)]))[:most]


def postings(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id, field, pos, token): every occurrence."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), tokens(F.col(c)).alias("ts")) for c in text_cols])
    return (
        df.select(F.col(id_col).alias("id"), F.explode(fields).alias("f"))
        .select("id", "f.field", F.posexplode("f.ts").alias("pos", "token"))
    )


def inverted(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id, field, token, positions, n_tokens): a row for each distinct token of a field.

    ``n_tokens`` is the length of all fields of the id. Ids are distinct, so positions of a group
    combine before the shuffle.
    """

    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias("ts")) for c in text_cols])
    rows = df.select(F.col(id_col).alias("id"), fields.alias("fs"))
    rows = rows.withColumn("n_tokens", F.aggregate("fs", F.lit(0), lambda s, f: s + F.size(f["ts"])))
    each = rows.select("id", "n_tokens", F.explode("fs").alias("f")).select("id", "n_tokens", "f.field", F.posexplode("f.ts").alias("pos", "token"))
    return each.groupBy("id", "field", "token").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("n_tokens").alias("n_tokens"))


def lengths(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id, n_tokens) without exploding: sizes of the token arrays."""
    total = sum((F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in text_cols), F.lit(0))
    return df.select(F.col(id_col).alias("id"), total.alias("n_tokens"))


def laid_out(index: DataFrame) -> DataFrame:
    """``index`` in ranges of tokens, sorted, so that files and row groups hold few tokens each.

    The range key ends with a hash of the id: a token that a large part of all documents has
    spreads over several files.
    """
    return index.repartitionByRange("token", F.xxhash64("id")).sortWithinPartitions("token", "id")


def hits_of(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, n_tokens, tf) of the ids with a hit; ``index`` as :func:`inverted` makes it."""
    wanted = sorted({t for p in phrases for t in p})
    rows = index.filter(F.col("token").isin(wanted))
    alone = all(len(p) == 1 for p in phrases)
    if alone:
        by_token = {t: F.sum(F.when(F.col("token") == t, F.size("positions")).otherwise(0)) for t in wanted}
        out = rows.groupBy("id").agg(F.first("n_tokens").alias("n_tokens"), F.array(*[by_token[p[0]] for p in phrases]).alias("tf"))
        return out.select("id", "n_tokens", F.col("tf").cast("array<long>").alias("tf"))
    at = {t: F.flatten(F.collect_list(F.when(F.col("token") == t, F.col("positions")))).alias(f"p{i}") for i, t in enumerate(wanted)}
    number = {t: i for i, t in enumerate(wanted)}
    per_field = rows.groupBy("id", "field").agg(F.first("n_tokens").alias("n_tokens"), *at.values())

    def count(phrase):
        first = F.col(f"p{number[phrase[0]]}")
        if len(phrase) == 1:
            return F.size(first)
        return F.size(F.filter(first, lambda i: reduce(and_, [F.array_contains(F.col(f"p{number[t]}"), i + j) for j, t in enumerate(phrase) if j])))

    tf = per_field.select("id", "n_tokens", *[count(p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    summed = tf.groupBy("id").agg(F.first("n_tokens").alias("n_tokens"), F.array(*[F.sum(f"tf{k}") for k in range(len(phrases))]).cast("array<long>").alias("tf"))
    return summed.filter(F.exists("tf", lambda n: n > 0))


def scanned(df: DataFrame, id_col: str, text_cols: list[str], phrases: list[list[str]]) -> DataFrame:
    """(id, n_tokens, tf) of every row: hits counted in the rows' own token arrays.

    For rows that aren't in an index. The phrases are a driver-side list of at most a few dozen.
    """

    def hits(ts, phrase):
        if len(phrase) == 1:
            return F.size(F.filter(ts, lambda t: t == phrase[0]))
        starts = F.when(F.size(ts) >= len(phrase), F.sequence(F.lit(0), F.size(ts) - len(phrase))).otherwise(F.array().cast("array<int>"))
        here = lambda i: reduce(and_, [F.get(ts, i + j) == t for j, t in enumerate(phrase)])
        return F.size(F.filter(starts, here))

    # The tokens of a field are a lambda's variable, so they are made once and not for each use.
    fields = F.transform(F.array(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in text_cols]), lambda ts: F.struct(F.size(ts).alias("n"), F.array(*[hits(ts, p) for p in phrases]).alias("tf")))
    per_field = df.select(F.col(id_col).alias("id"), fields.alias("fields"))
    total = F.aggregate("fields", F.lit(0), lambda s, f: s + f["n"])
    tf = F.transform(F.sequence(F.lit(0), F.lit(len(phrases) - 1)), lambda k: F.aggregate("fields", F.lit(0), lambda s, f: s + F.get(f["tf"], k)))
    return per_field.select("id", total.alias("n_tokens"), tf.cast("array<long>").alias("tf"))


def totals(sizes: DataFrame) -> DataFrame:
    """One row (n_rows, sum_len) of a table of lengths."""
    return sizes.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double").alias("sum_len"))


def scored(hits: DataFrame, corpus: DataFrame, n_phrases: int, limit: int | None = None) -> DataFrame:
    """(id, score), best first, ties by id, of ``hits`` and the one-row ``corpus`` totals."""
    found = hits.agg(*[F.coalesce(F.sum((F.get("tf", F.lit(k)) > 0).cast("long")), F.lit(0)).alias(f"df{k}") for k in range(n_phrases)])
    # Both sides of these joins are aggregates of one row each.
    rows = hits.filter(F.exists("tf", lambda n: n > 0)).join(F.broadcast(found)).join(F.broadcast(corpus))
    score = F.lit(0.0)
    for k in range(n_phrases):
        tf, n = F.get("tf", F.lit(k)).cast("double"), F.col(f"df{k}")
        raw = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") * F.col("n_rows") / F.col("sum_len")))
    ordered = rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id")
    return ordered.limit(limit) if limit else ordered


def bm25(index: DataFrame, sizes: DataFrame, phrases: list[list[str]], limit: int | None = None) -> DataFrame:
    """(id, score) from an index and its lengths: reads the query's tokens and no text."""
    return scored(hits_of(index, phrases), totals(sizes), len(phrases), limit)

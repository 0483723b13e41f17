"""Quality classifier from weak labels.

Eleven overlapping heuristics vote good, bad or nothing on each whole text. Expectation-
maximisation over the counts of vote patterns (at most 3**11 of them at any corpus size, taken
over all documents) estimates how often each heuristic votes what, given the hidden class, and
the share of good texts. The posterior of a text's pattern is its weak label. A hashed linear
scorer (logistic regression on byte n-grams) then learns the posteriors themselves, not the class
they lean to, of at most ``TRAIN_ROWS`` rows, so that it also judges texts on which the heuristics are silent.

Defined cases: null and wordless texts get score 0 and aren't kept or learned from; very long
texts are read whole; repeated rows count and are scored each; if the sampled rows are of one
class only the scorer gives the posterior; an empty table gives an empty result; a kept column with
the name of a result gives way to it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, map_text
from corpusgraph.llm.langid import DIMENSIONS, ngram_rows, train_bits

TRAIN_ROWS = 2000
#: Least score of a kept text. Classes weigh alike in training while most texts are good, so this
#: stands above the middle.
KEEP = 0.7
HEURISTICS = ("upper", "shouting", "symbols", "word_length", "repeated_lines", "digits", "length", "diversity", "line_ends", "letterless", "runs")
BAD, GOOD, SILENT = "0", "1", "-"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
# Words without a letter, and marks that are doubled.
LETTERLESS, RUN = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]++(?!\S)"), re.compile(rb"([^\sA-Za-z0-9\x80-\xff])\1")
PLAIN = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b" \n\t\r.,;:!?'\"()-"


def _vote(value: float, bad, good) -> str:
    return BAD if bad(value) else GOOD if good(value) else SILENT


def votes(text: str | None) -> str:
    """One character a heuristic; empty for a null or wordless text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return ""
    n, w = len(raw), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda some: n - len(raw.translate(None, some))
    return "".join(
        (
            _vote(count(UPPER) / n, lambda x: x > 0.2, lambda x: x < 0.06),
            _vote(raw.count(b"!") / w, lambda x: x > 0.05, lambda x: x < 0.002),
            _vote((n - count(PLAIN)) / n, lambda x: x > 0.05, lambda x: x < 0.01),
            _vote(n / w, lambda x: x < 3.5 or x > 12, lambda x: 4.5 < x < 9),
            _vote(len(set(lines)) / len(lines), lambda x: x < 0.7, lambda x: len(lines) > 3 and x > 0.95),
            _vote(count(DIGITS) / n, lambda x: x > 0.15, lambda x: x < 0.02),
            _vote(w, lambda x: x < 6, lambda x: x >= 60),
            _vote(len(set(words)) / w, lambda x: w > 20 and x < 0.15, lambda x: w > 20 and x > 0.4),
            _vote(sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / len(lines), lambda x: x < 0.2, lambda x: x > 0.8),
            _vote(len(LETTERLESS.findall(raw)) / w, lambda x: x > 0.2, lambda x: x < 0.05),
            _vote(len(RUN.findall(raw)) / w, lambda x: x > 0.05, lambda x: x < 0.005),
        )
    )


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good texts, P(vote | class) a heuristic, and each pattern's posterior."""
    names = sorted(patterns)
    if not names:
        return 0.5, np.zeros((0, 2, 3)), {}
    n = np.array([patterns[p] for p in names], dtype=np.float64)
    at = np.array([["01-".index(c) for c in p] for p in names])
    one_hot = np.eye(3)[at]
    # Start from the votes' majority; smoothing keeps every probability positive.
    lead = (at == 1).sum(axis=1) - (at == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-lead.astype(np.float64)))
    share, given = 0.5, None
    for _ in range(rounds):
        share = float((n * good).sum() / n.sum())
        by_class = np.stack([n * (1 - good), n * good])
        given = np.einsum("cp,phv->hcv", by_class, one_hot) + 1.0
        given /= given.sum(axis=2, keepdims=True)
        log = np.einsum("phv,hcv->pc", one_hot, np.log(given)) + np.log(np.clip([1 - share, share], 1e-9, 1))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return share, given, dict(zip(names, good.tolist(), strict=True))


def accuracies(share: float, given: np.ndarray) -> dict[str, float]:
    """Estimated accuracy of each heuristic where it votes."""
    out = {}
    for name, g in zip(HEURISTICS, given, strict=False):
        right = (1 - share) * g[0][0] + share * g[1][1]
        out[name] = float(right / ((1 - share) * (g[0][0] + g[0][1]) + share * (g[1][0] + g[1][1])))
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Posteriors of vote patterns over all documents, and the scorer they train."""

    def make():
        return lambda texts: [[votes(s) for s in texts.to_pylist()]]

    counts = map_text(docs, make, [("votes", "string")], text=text_col, keep=[]).filter("votes <> ''").groupBy("votes").count()
    patterns = {r[0]: r[1] for r in counts.collect()}
    share, given, posterior = estimate(patterns)
    total = sum(patterns.values())
    part = F.pmod(F.xxhash64(col(id_col).cast("string"), col(text_col)), F.lit(1_000_003))
    some = docs.filter(part <= int(min(1.0, 1.2 * TRAIN_ROWS / max(1, total)) * 1_000_003)).select(col(text_col).alias("t"), part.alias("part"))

    def features():
        def f(texts):
            rows = [s or "" for s in texts.to_pylist()]
            x = ngram_rows(rows, fold=False)
            return [[votes(s) for s in rows], [np.flatnonzero(r).astype(np.int32).tolist() for r in x], [r[r > 0].astype(np.float32).tobytes() for r in x]]

        return f

    sampled = map_text(some, features, [("votes", "string"), ("at", "array<int>"), ("has", "binary")], text="t", keep=["part"]).filter("votes <> ''").orderBy("part", "votes").limit(TRAIN_ROWS).collect()
    weights = None
    if sampled:
        x = np.zeros((len(sampled), DIMENSIONS), dtype=np.float32)
        y = np.array([posterior.get(r[1], 0.5) for r in sampled])
        for i, r in enumerate(sampled):
            x[i, np.array(r[2], dtype=np.int64)] = np.frombuffer(bytes(r[3]), dtype=np.float32)
        # Each row is both a good and a bad example, by its posterior; both classes weigh alike.
        good, bad = y.sum(), (1 - y).sum()
        if min(good, bad) > 1e-6 * len(y):
            either = np.concatenate([np.ones(len(y)), -np.ones(len(y))])[:, None]
            part = np.concatenate([y / good, (1 - y) / bad])
            weights, _ = train_bits(np.vstack([x, x]), either, sample_weights=part * len(y))
    return {"share": share, "accuracy": accuracies(share, given), "posterior": posterior, "weights": weights}


def score(docs: DataFrame, model: dict, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``) with votes, posterior, quality_score and keep."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def f(texts):
            rows = [s or "" for s in texts.to_pylist()]
            pattern = [votes(s) for s in rows]
            post = [model["posterior"].get(p, model["share"]) if p else 0.0 for p in pattern]
            if model["weights"] is None:
                got = list(post)
            else:
                w, got = model["weights"], []
                for k in range(0, len(rows), 128):
                    margin = ngram_rows(rows[k : k + 128], fold=False) @ w[:-1, 0] + w[-1, 0]
                    got += (1 / (1 + np.exp(-np.clip(margin, -30, 30)))).astype(float).tolist()
                got = [g if p else 0.0 for g, p in zip(got, pattern, strict=True)]
            return [pattern, post, got, [g >= KEEP for g in got]]

        return f

    return map_text(docs, make, [("votes", "string"), ("posterior", "double"), ("quality_score", "double"), ("keep", "boolean")], text=text_col, keep=keep)


def classify(docs: DataFrame, *, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(docs, id_col=id_col, text_col=text_col), keep=keep, text_col=text_col)

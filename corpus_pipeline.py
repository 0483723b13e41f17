"""Training-data pipeline: language ID, near-dedup, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each
stage's result as Parquet in the shared folder and rereads it as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.llm import decontaminate, langid, neardup, pii, pieces
from corpusgraph.llm.common import col, cut, discard, scratch, table

#: A text whose best language scores less is dropped.
LEAST_SCORE = 0.3
#: Columns that stages read; no operator has a result of these names.
ROLES = ("doc_id", "text", "lang")


def shielded(docs, operator, *, keep=None, replace=None, add=None):
    """``operator`` on ``docs`` while columns that it doesn't read bear other names.

    So no column of the documents gives way to one of the result. Rows for which ``keep`` holds
    stay; ``replace`` names columns of the result that take the place of a document's; ``add``
    those that are appended.
    """
    plain = [c if c in ROLES else f"__user{i}" for i, c in enumerate(docs.columns)]
    out = operator(docs.toDF(*plain))
    out = out if keep is None else out.filter(keep)
    taken = [(replace or {}).get(c, col(p)).alias(c) for c, p in zip(docs.columns, plain, strict=True)]
    return out.select(*taken, *(add or []))


def language(spark, docs, sf_dir):
    """Drops texts without letters and those no language fits; ``lang`` becomes the prediction."""
    fits = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return shielded(docs, langid.identify, keep=fits, replace={"lang": F.col("lang_pred")})


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of copies and near copies."""
    return neardup.drop_near_copies(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a run of a whole window's benchmark words, or are made of them.

    A hit of an item of fewer words than a window counts only by the contaminated share, so
    that a benchmark answer of one word doesn't empty the corpus.
    """

    def mark(plain):
        return decontaminate.decontaminate(plain, table(spark, sf_dir, "benchmark"))

    at = F.sequence(F.lit(0), F.size("hit_ranges") - 2, F.lit(2))
    runs = F.transform(F.when(F.size("hit_ranges") > 0, at), lambda i: F.get("hit_ranges", i + 1) - F.get("hit_ranges", i))
    clean = ~F.col("contaminated") & F.coalesce(F.array_max(runs) < decontaminate.WINDOW, F.lit(True))
    return shielded(docs, mark, keep=clean)


def personal_data(spark, docs, sf_dir):
    """Replaces personal data by its kind and brings n_chars up to date."""
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return shielded(docs, lambda plain: pii.find(plain, redact=True), replace=new)


def tokens(spark, docs, sf_dir):
    """Sampled piece ids of each text, decoded again: ``lossless`` tells whether the text came back.

    The last stage's own columns take the place of a document's columns of their names.
    """
    made = {"piece_ids": F.col("piece_ids"), "lossless": F.col("lossless"), "n_pieces": F.size("piece_ids")}
    others = docs.select(*[col(c) for c in docs.columns if c.lower() not in made])
    return shielded(others, pieces.round_trip, add=[x.alias(name) for name, x in made.items()]).drop("text")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding", tokens),
]
#: Trained weights, transducers and sampled pieces aren't expressible in SQL; tests hold the
#: pipeline against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")))
        discard(before)
    return docs

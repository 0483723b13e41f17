"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier for each bit of the code is a logistic
regression on hashed byte n-grams (square roots of relative frequencies). A text gets the
language whose codeword has the least loss-weighted distance to the classifiers' margins,
where a bit weighs as much as its classifier is better than chance on the training rows.
``ambiguous`` flags texts whose runner-up is close.

Training takes at most ``per_language`` rows of each language (chosen by a hash of the id,
whole texts, features computed on the executors) and every language of the training part; the
driver holds 16 KB for each of these rows. Prediction reads nothing but the text.

Defined cases: a null text or one without a letter is ``und`` with score 0; null languages
and ids outside of the training part aren't learned from; one learned language is predicted
for every text with letters; with none every text is ``und``; letters are Unicode's category L, so
fractions and Roman number signs are none; repeated rows are scored each; a kept column with the
name of a result gives way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, map_text

DIMENSIONS = 4096
PER_LANGUAGE = 400
AMBIGUOUS = 0.2
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L."""
    return any(map(str.isalpha, text))


def ngram_rows(texts: list[str], fold: bool = True) -> np.ndarray:
    """A row of square-rooted relative frequencies of hashed byte 2- and 3-grams a text."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(b" " + (text.lower() if fold else text).encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
        for h in (two, three):
            out[i] += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1: the exhaustive code up to 7 languages, else a random code."""
    if n <= 2:
        return np.array([[1], [-1]][:n], dtype=np.float64).reshape(n, -1)
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        first = np.ones((1, bits))
        rest = np.array([[1 if (b >> (n - 2 - i)) & 1 else -1 for b in range(bits)] for i in range(n - 1)], dtype=np.float64)
        return np.vstack([first, rest])
    rng = np.random.default_rng(n)
    width = int(np.ceil(10 * np.log2(n)))
    best = None
    for _ in range(40):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        apart = (code @ code.T)[~np.eye(n, dtype=bool)].max()
        if best is None or apart < best[0]:
            best = (apart, code)
    return best[1]


def train_bits(x: np.ndarray, targets: np.ndarray, sweeps: int = 60, rate: float = 40.0, decay: float = 1e-5, sample_weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all bits at once by accelerated full-batch descent."""
    w = np.zeros((x.shape[1] + 1, targets.shape[1]), dtype=np.float32)
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    ahead, step = w.copy(), 1.0
    weight = np.ones((len(x), 1), dtype=np.float32) if sample_weights is None else sample_weights.astype(np.float32)[:, None]
    for _ in range(sweeps):
        margin = np.clip(targets * (x @ ahead), -30, 30)
        grad = -(x.T @ (weight * targets / (1 + np.exp(margin)))).astype(np.float32) / len(x) + decay * ahead
        new = ahead - rate / 4 * grad
        nxt = (1 + np.sqrt(1 + 4 * step * step)) / 2
        ahead, w, step = new + np.float32((step - 1) / nxt) * (new - w), new, nxt
    return w, x @ w


def train(docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> dict:
    """Model of the rows for which the column ``learn`` holds, at most ``per_language`` of each language."""
    rows = docs.select(col(id_col).alias("i"), col(text_col).alias("t"), col(lang_col).alias("l")).filter(learn & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = rows.groupBy("l").count()
    langs = sorted(r[0] for r in counts.select("l").collect())
    if not langs:
        return {"langs": []}
    part = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("langid")), F.lit(1_000_003))
    # A hash threshold takes about 1.2 times the bound; the bound itself is held below.
    wanted = part <= (F.least(F.lit(1.0), F.lit(1.2 * per_language) / F.col("count")) * 1_000_003).cast("long")

    def make():
        def f(texts, langs):
            x = ngram_rows(texts.to_pylist())
            return [[np.flatnonzero(r).astype(np.int32).tolist() for r in x], [r[r > 0].astype(np.float32).tobytes() for r in x]]

        return f

    # Rows of one id and text are one example, however often they repeat, so what is fetched is bounded.
    some = rows.join(F.broadcast(counts), "l").filter(wanted).withColumn("p", part).groupBy("l", "p", F.xxhash64("t").alias("h")).agg(F.min("t").alias("t"))
    sampled = map_text(some, make, [("at", "array<int>"), ("has", "binary")], text="t", keep=["l", "p", "h"], args=["l"]).orderBy("p", "h").limit(2 * per_language * len(langs))
    taken, index, x, y = dict.fromkeys(langs, 0), {name: i for i, name in enumerate(langs)}, [], []
    for r in sampled.collect():
        if taken[r["l"]] < per_language:
            taken[r["l"]] += 1
            row = np.zeros(DIMENSIONS, dtype=np.float32)
            row[np.array(r["at"], dtype=np.int64)] = np.frombuffer(bytes(r["has"]), dtype=np.float32)
            x.append(row)
            y.append(index[r["l"]])
    langs_of, code = np.array(y, dtype=np.int64), codewords(len(langs))
    if len(langs) == 1 or not x:
        return {"langs": langs, "w": None}
    # Languages weigh alike however many rows they have.
    x = np.array(x)
    w, margins = train_bits(x, code[langs_of])
    right = ((margins * code[langs_of]) > 0).mean(axis=0)
    weights = np.maximum(2 * right - 1, 0.05)
    return {"langs": langs, "w": w, "code": code, "bit_weights": weights / weights.sum()}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score, and the lead over the runner-up."""
    margins = x @ model["w"][:-1] + model["w"][-1]
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * model["code"][None], -30, 30))) @ model["bit_weights"]
    near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p = near / near.sum(axis=1, keepdims=True)
    ordered = np.sort(p, axis=1)
    return p.argmax(axis=1), ordered[:, -1], ordered[:, -1] - ordered[:, -2]


def predict(docs: DataFrame, model: dict, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``) with lang_pred, score and ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def f(texts):
            rows = texts.to_pylist()
            named, score, close = [UNDETERMINED] * len(rows), [0.0] * len(rows), [False] * len(rows)
            at = [i for i, s in enumerate(rows) if s is not None and has_letter(s)] if model["langs"] else []
            # Decoding takes a number for each row and bit of every codeword.
            step = max(1, min(128, 2_000_000 // model["code"].size)) if model.get("w") is not None else 128
            for k in range(0, len(at), step):
                some = at[k : k + step]
                if model["w"] is None:
                    best, p, lead = [0] * len(some), [1.0] * len(some), [1.0] * len(some)
                else:
                    best, p, lead = decode(model, ngram_rows([rows[i] for i in some]))
                for i, b, s, d in zip(some, best, p, lead, strict=True):
                    named[i], score[i], close[i] = model["langs"][b], float(s), bool(d < AMBIGUOUS)
            return [named, score, close]

        return f

    return map_text(docs, make, [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")], text=text_col, keep=keep)


def held_out(id_col: str = "doc_id"):
    """Whether a row's id puts it outside of the training part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the rows of ``docs`` that aren't held out and predict every row."""
    known = F.col("i").isNotNull() & ~held_out("i")
    return predict(docs, train(docs, known, id_col, text_col, lang_col, per_language), keep=keep, text_col=text_col)

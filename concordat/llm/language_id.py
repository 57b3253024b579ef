"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. One linear classifier in numpy for each
bit is trained on hashed character n-grams (1 to 3 characters, runs of letters
only) of a text. Decoding is loss-weighted: a language's loss is the sum over
bits of ``exp(-margin)`` with the margin taken in the sense of its codeword,
weighted by how well that bit did for that language in training; the nearest
codeword wins. ``ambiguous`` flags texts whose two best losses are close, and
``score`` is the softmax share of the best.

Training reads a bounded sample (``max_train`` rows expected, taken by a hash of
the id) of learning-fold rows with text and language; prediction reads every
whole text, with no cap. A null text or one without letters is ``und`` with
score 0. With no training rows all texts are ``und``. Languages, ids and
sources are never features. Rows repeat as they do in the input; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import learning_fold, map_rows, prepare

BINS = 2048
UND = "und"


@dataclass(frozen=True)
class Params:
    max_train: int = 6000
    ridge: float = 1e-3
    sharpness: float = 4.0
    ambiguous_margin: float = 0.1
    seed: int = 11


@dataclass
class Model:
    labels: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # BINS + 1 x bits
    trust: np.ndarray  # languages x bits, each row sums to 1


def codewords(k: int, rng: np.random.Generator) -> np.ndarray:
    """k codewords. Few languages: every split into two parts. More: the random code of greatest least distance."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        return np.array([[1] + [1 if c >> (i - 1) & 1 else -1 for i in range(1, k)] for c in range(2 ** (k - 1) - 1)], float).T
    bits, best, out = int(np.ceil(10 * np.log2(k))), -1, None
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (k, bits))
        c = c[:, np.abs(c.sum(0)) < k]
        d = (c.shape[1] - (c @ c.T)[~np.eye(k, dtype=bool)].max()) / 2
        if d > best:
            best, out = d, c
    return out


def features(text: str | None) -> np.ndarray | None:
    """Normalised counts of hashed n-grams of letters; None if there is no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[np.minimum(cp, len(LETTERS) - 1)]
    if len(LETTERS) <= cp.max():
        high = cp >= len(LETTERS)
        letter[high] = [chr(c).isalpha() for c in cp[high]]
    if not letter.any():
        return None
    a = np.where(letter, cp, 32)
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)  # a run of other characters is one space
    a = a[keep] * np.uint32(2654435761)
    two = (a[:-1] ^ (a[1:] >> np.uint32(7))) * np.uint32(2246822519)
    three = (two[:-1] ^ (a[2:] >> np.uint32(5))) * np.uint32(3266489917)
    idx = np.concatenate((a, two, three)) >> np.uint32(21)
    v = np.sqrt(np.bincount(idx, minlength=BINS).astype(np.float32))
    return v / np.linalg.norm(v)


LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def train(x: np.ndarray, y: list[str], params: Params = Params()) -> Model:
    """Ridge-regularised least squares for each bit, classes weighted alike."""
    labels = sorted(set(y))
    k = np.array([labels.index(v) for v in y])
    codes = codewords(len(labels), np.random.default_rng(params.seed))
    x1 = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    share = np.bincount(k, minlength=len(labels))
    wt = (len(k) / len(labels) / share)[k][:, None]
    gram = x1.T @ (x1 * wt) + params.ridge * len(x) * np.eye(x1.shape[1]) / len(labels)
    weights = np.linalg.solve(gram, x1.T @ (codes[k] * wt))
    right = (x1 @ weights) * codes[k] > 0
    trust = np.array([right[k == i].mean(0) for i in range(len(labels))]) + 1e-3
    return Model(labels, codes, weights.astype(np.float32), trust / trust.sum(1, keepdims=True))


def decode(model: Model, x: np.ndarray, params: Params = Params()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and ambiguity flags of rows of features. Of equal losses the first language by name wins, flagged ambiguous."""
    margin = (x @ model.weights[:-1] + model.weights[-1])[:, None, :] * model.codes
    loss = (np.exp(-margin) * model.trust).sum(2)
    p = np.exp(-params.sharpness * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(loss, 1)
    close = top[:, 1] - top[:, 0] < params.ambiguous_margin if loss.shape[1] > 1 else np.zeros(len(x), bool)
    return [model.labels[i] for i in best], p[np.arange(len(x)), best], close


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Codes and classifiers learnt from learning-fold rows only; None if there are none."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(learning_fold("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.count()
    if not total:
        return None
    rate = 1_000_000
    share = min(1.0, params.max_train / total)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(rate)) < share * rate).select("doc_id", "lang", "text")

    def start():
        def step(b: pa.RecordBatch) -> dict:
            x = [features(t) for t in b.column(2).to_pylist()]
            return {"doc_id": b.column(0), "lang": b.column(1), "x": [None if v is None else v.astype(np.float16).tobytes() for v in x]}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])
    got = map_rows(sample, start, schema, "doc_id long, lang string, x binary").where("x is not null").collect()
    got = sorted((r.doc_id, r.lang, bytes(r.x)) for r in got)
    if not got:
        return None
    x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(len(got), BINS).astype(np.float32)
    return train(x, [r[1] for r in got], params)


def predict(docs: DataFrame, model: Model | None, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x bits: under 1 MB for 100 languages

    def start():
        m = shared.value

        def step(b: pa.RecordBatch) -> dict:
            n = b.num_rows
            lang, score, close = [UND] * n, [0.0] * n, [False] * n
            found = [(i, v) for i, t in enumerate(b.column(1).to_pylist()) if m and (v := features(t)) is not None]
            if found:
                names, p, amb = decode(m, np.array([v for _, v in found]), params)
                for (i, _), a, s, c in zip(found, names, p, amb):
                    lang[i], score[i], close[i] = a, float(s), bool(c)
            return {"doc_id": b.column(0), "lang_pred": lang, "score": score, "ambiguous": close}

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, schema, "doc_id long, lang_pred string, score double, ambiguous boolean")

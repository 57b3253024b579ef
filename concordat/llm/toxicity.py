"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts are the positives; the unlabelled set is drawn from all
documents, whether they have a label or not, and whatever it says. A linear
classifier in numpy is trained by gradient descent (Adam) on the non-negative
risk estimator (logistic loss), ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``.
``pi``, the class prior, is ``Params.prior``, or else the share of toxic rows
among the labelled ones of the learning folds.

Features: the distinct words of a whole text and their character 4-grams,
hashed. Only features that are telling count: their share of the positives is
``ratio`` times that of the unlabelled texts at least, whatever the number of
texts, and surely more than chance (see ``telling``). A text's logit is a bias
plus the weights of its features, divided by the root of the number of all its
features (the norm of its vector), so that no text gathers a score by length. A
text of more than ``WINDOW`` words is scored by the most toxic of the whole and of
its stretches of so many words (they begin every ``STEP`` words, the last one ends
with the text), so that clean text hides no toxic stretch. A stretch counts without
its one strongest word: of the many stretches of a long text some hold a word that
is there by chance, which alone is no evidence.

Training reads a bounded sample (``max_positive``, ``max_unlabelled``: expected
sizes, taken by a hash of the id). Feature counts of the sample are summed in
Spark; the driver gets the telling features and which of them each text has.
Scoring covers every row. Null and empty texts have no words: their score is
that of the bias alone. Labels are joined by id for training only; ids,
languages and sources are never features. With no positive training row every
score is 0. A score of exactly 0.5 counts as toxic. Rows repeat as they do in
the input; an id with several labels is positive if one of them is.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import learning_fold, map_rows, prepare, words
from concordat.session import materialize

BITS = 20
GRAM = 4
#: Words of a stretch that is scored, and words from one stretch to the next.
WINDOW, STEP = 200, 100
#: Words a Python worker remembers; beyond that the memory starts anew.
MEMO = 400_000
#: Bytes of the longest word that is remembered.
KEEP = 64


@dataclass(frozen=True)
class Params:
    max_positive: int = 4000
    max_unlabelled: int = 8000
    prior: float | None = None  # None: estimated from the labels of the learning folds
    ratio: float = 3.0  # least ratio of a feature's shares in positive and unlabelled texts
    least: int = 3  # positive texts that a feature needs
    steps: int = 600
    rate: float = 0.03
    decay: float = 1e-3
    slack: float = 0.0  # the negative risk may fall so far under 0, in units of the prior
    seed: int = 7


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word: itself and its 4-grams of characters."""
    mask = (1 << BITS) - 1
    h = xxhash.xxh32_intdigest
    out = [h(word, 1) & mask]
    s = word.decode("utf-8", "replace")
    if len(s) > GRAM:
        out += [h(s[i : i + GRAM].encode(), 2) & mask for i in range(len(s) - GRAM + 1)]
    elif len(s) == GRAM:
        out.append(h(word, 2) & mask)
    return out


def text_features(text: str | None) -> np.ndarray:
    """Features of the distinct words of a text; one that several words share repeats."""
    return np.fromiter((f for w in set(words(text)) for f in word_features(w)), np.int32)


def telling(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, tried: int, params: Params = Params()) -> np.ndarray:
    """Log ratio of a feature's shares in ``n_p`` positive and ``n_u`` unlabelled texts where it is telling, else 0.

    Telling: the ratio is ``params.ratio`` at least, however many texts there
    are, and the likelihood ratio (G) exceeds what the largest of ``tried``
    features would reach by chance.
    """
    both = np.maximum(p + u, 1) / (n_p + n_u)
    g = 2 * (p * np.log(np.maximum(p, 1) / (both * n_p)) + u * np.log(np.maximum(u, 1) / (both * n_u)))
    r = np.log((p + 0.5) / (n_p + 1)) - np.log((u + 0.5) / (n_u + 1))
    sure = (r >= np.log(params.ratio)) & (g > 2 * np.log(max(tried, 2)))
    return np.where(sure, r, 0)


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], norm: np.ndarray, r: np.ndarray, prior: float, params: Params = Params()) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss (Adam).

    ``pos`` and ``unl`` hold each text's telling features as places in ``r``,
    their log ratios; ``norm`` the norms of all texts, positive ones first.
    """
    n_p, n_u = len(pos), len(unl)
    if not n_p or not n_u or not 0 < prior < 1:
        return np.zeros(len(r)), -30.0
    if not len(r):
        return np.zeros(0), float(np.log(prior / (1 - prior)))
    scale = float(norm[n_p:].mean())  # keeps the inputs at the size of the log ratios
    idx = np.concatenate(pos + unl)
    row = np.repeat(np.arange(n_p + n_u), [len(x) for x in pos + unl])
    x = r[idx] * (scale / norm)[row]
    theta = np.append(np.full(len(r), 0.1), 0.0)  # weights, then the bias
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    dz = np.empty(n_p + n_u)
    for step in range(1, params.steps + 1):
        z = np.bincount(row, theta[idx] * x, n_p + n_u) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)  # of the label -1
        # Logistic loss: its slope in z is s for the label -1 and s - 1 for +1.
        if loss[n_p:].mean() - prior * loss[:n_p].mean() >= -params.slack * prior:
            dz[:n_p] = -prior / n_p  # of prior * (R_p(+) - R_p(-))
            dz[n_p:] = s[n_p:] / n_u
        else:  # the estimated negative risk fell under 0: step back from it
            dz[:n_p] = prior * s[:n_p] / n_p
            dz[n_p:] = -s[n_p:] / n_u
        g = np.append(np.bincount(idx, dz[row] * x, len(r)), dz.sum()) + params.decay * theta
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g * g - m2)
        theta -= params.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # a feature is evidence for, or none
    return theta[:-1] * r * scale, float(theta[-1])


def _sample(docs: DataFrame, labels: DataFrame, params: Params, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame | None, float]:
    """(positive, n, f) of the training texts, written once, and the class prior; f holds int32 features."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learning_fold("doc_id") & F.col("y").isNotNull())
    n_pos, n_lab = lab.agg(F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    if not n_pos:
        return None, 0.0
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(learning_fold("doc_id"))
    rate = 1_000_000

    def drawn(most: int, of: int, seed: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(rate)) < min(1.0, most / max(of, 1)) * rate

    few = materialize(lab.where(F.col("y") == 1).select("doc_id").distinct().where(drawn(params.max_positive, n_pos, params.seed)), "positive")
    # The ids are few by the parameter; were they not, texts would be shuffled to meet them.
    few = F.broadcast(few) if few.count() <= 2 * params.max_positive else few
    pos = texts.join(few, "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unl = texts.where(drawn(params.max_unlabelled, texts.count(), params.seed + 1)).select(F.lit(False).alias("positive"), "text")

    def start():
        def step(b: pa.RecordBatch) -> dict:
            fs = [text_features(x) for x in b.column(1).to_pylist()]
            return {"positive": b.column(0), "n": [len(f) for f in fs], "f": [np.unique(f).tobytes() for f in fs]}

        return step

    schema = pa.schema([("positive", pa.bool_()), ("n", pa.int64()), ("f", pa.binary())])
    made = map_rows(pos.unionByName(unl), start, schema, "positive boolean, n long, f binary")
    return materialize(made, "features"), params.prior if params.prior is not None else n_pos / n_lab


def _counts(sample: DataFrame) -> DataFrame:
    """(f, p, u): how many positive and unlabelled texts have a feature. A task adds up its own first."""

    def run(batches):
        c = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for positive, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c[int(not positive), np.frombuffer(f, np.int32)] += 1
        at = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[0, at]), pa.array(c[1, at])], names=["f", "p", "u"])

    return sample.select("positive", "f").mapInArrow(run, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """(weights, bias) learnt from rows in the learning folds only."""
    prepare(docs.sparkSession)
    w = np.zeros(1 << BITS, np.float32)
    sample, prior = _sample(docs, labels, params, id_col, text_col, label_col)
    if sample is None:
        return w, -30.0
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    near = materialize(_counts(sample).where(F.col("p") >= params.least), "counts")  # 2 ** BITS rows at most
    tried = near.count()
    strong = near.where((F.col("p") + 0.5) / (n_p + 1) >= F.lit(params.ratio) * (F.col("u") + 0.5) / (n_u + 1)).sort("f").collect()
    f, p, u = (np.array([x[c] for x in strong], np.int64) for c in ("f", "p", "u"))
    r = telling(p, u, n_p, n_u, tried, params)
    used, r = f[r > 0], r[r > 0]
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def cut(batches):
        """Each text's telling features as places in ``used``; there are no more than of these."""
        place = np.full(1 << BITS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for b in batches:
            at = [place[np.frombuffer(f, np.int32)] for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[x >= 0].tobytes() for x in at], pa.binary())], names=["positive", "n", "f"])

    rows = sorted((not x["positive"], x["n"], bytes(x["f"])) for x in sample.select("positive", "n", "f").mapInArrow(cut, "positive boolean, n long, f binary").collect())
    feats = [np.frombuffer(f, np.int32) for _, _, f in rows]
    norm = np.sqrt([max(n, 1) for _, n, _ in rows])
    theta, bias = train_nnpu(feats[:n_p], feats[n_p:], norm, r, prior, params)
    w[used] = theta
    return w, bias


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(w, np.float32), float(bias)))  # 4 MB, fixed by BITS

    def start():
        of = scorer(*shared.value)
        return lambda b: {"doc_id": b.column(0), "score": [of(x) for x in b.column(1).to_pylist()]}

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, schema, "doc_id long, score double")


def scorer(w: np.ndarray, bias: float):
    """A function from a text to its score."""
    memo: dict[bytes, tuple[float, int]] = {}
    weights = array("f", w)

    def logit(stretch: list[bytes], chance: bool = False) -> float:
        """Logit of some words; with ``chance`` without the strongest of them."""
        z, n, top = 0.0, 0, 0.0
        for x in set(stretch):
            try:
                a, k = memo[x]
            except KeyError:
                fs = word_features(x)
                a, k = sum(weights[i] for i in fs), len(fs)
                if len(x) <= KEEP:
                    memo[x] = a, k
            z += a
            n += k
            if a > top:
                top = a
        return bias + (z - top if chance else z) / max(n, 1) ** 0.5

    def of(text: str | None) -> float:
        if len(memo) > MEMO:
            memo.clear()
        ws = words(text)
        z = logit(ws)
        if len(ws) > WINDOW:
            z = max(z, max(logit(ws[i : i + WINDOW], True) for i in stretches(len(ws))))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    return of


def stretches(n: int) -> list[int]:
    """Where the stretches of a text of ``n`` words begin: every word is in one."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores under ``threshold``."""
    w, bias = model
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((np.asarray(w, np.float32), float(bias)))
    at = docs.columns.index(text_col)

    def run(batches):
        of = scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([of(x) < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_clean(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """``drop_toxic`` by a model learnt from these rows and labels."""
    return drop_toxic(docs, fit(docs, labels, params), threshold)

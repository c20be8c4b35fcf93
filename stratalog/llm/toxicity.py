"""Toxicity by a classifier chain.

The categories, 0/1 columns of the labels table in a given order, are predicted one after another by
logistic regressions over which words and beginnings of words (of PREFIXES letters, so that inflected
forms count together) of a vocabulary a text holds; each later model also sees the earlier categories'
probabilities. In training these are out-of-fold predictions, so that a later model learns how far to
trust them on unseen texts. The last category decides; where it has no label a row is not used, and
where an earlier one has none the row is left out of that category's training only.

The models are fitted on a bounded sample: at most SAMPLE labelled documents, those with the
smallest hashes of doc_id. The vocabulary has at most WORDS words, those that tell most (by
chi-square) of the ones in at least LEAST sampled documents. Scoring covers every document and whole texts.

Defined cases: texts without any word of the vocabulary, as null and empty ones, get the chain's base rates and are not toxic; labels without a
document, or null, are not used; of several labels of a document the largest holds; without
labelled rows of both classes nothing is toxic (probability 0); repeated rows are scored each; an
empty table gives an empty table; other columns are passed over or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import saved

SAMPLE = 8_000
WORDS = 2_048
LEAST = 5
PREFIXES = (4, 5, 6)
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")

@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: np.ndarray  # categories x (words + earlier categories + 1)
    threshold: float

    def predict(self, ids: list[np.ndarray]) -> np.ndarray:
        """Probabilities, documents x categories."""
        if not self.vocabulary:
            return np.zeros((len(ids), len(self.names)))
        return _predict(self.weights, len(self.vocabulary), *_flat(ids))

    def rejects(self, ids: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        return (p[:, -1] >= self.threshold) & np.array([len(x) > 0 for x in ids], bool)


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return rows, np.concatenate(ids) if ids else np.zeros(0, np.int64), len(ids)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _predict(weights: np.ndarray, words: int, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(weights)))
    for c, w in enumerate(weights):
        out[:, c] = _sigmoid(np.bincount(rows, w[ids], n) + out[:, :c] @ w[words : words + c] + w[-1])
    return out


def _regress(rows: np.ndarray, ids: np.ndarray, extra: np.ndarray, y: np.ndarray, words: int, steps: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam on full batches; the last weight is the bias."""
    n, c = extra.shape
    w = np.zeros(words + c + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        wrong = (_sigmoid(np.bincount(rows, w[ids], n) + extra @ w[words:-1] + w[-1]) - y) / max(n, 1)
        slope = np.concatenate([np.bincount(ids, wrong[rows], words), extra.T @ wrong, [wrong.sum()]])
        slope[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _taken(rows: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.cumsum(keep) - 1
    here = keep[rows]
    return place[rows[here]], ids[here]


def fit_chain(names: tuple[str, ...], vocabulary: dict[str, int], ids: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """labels: documents x categories of the chain, nan where there is none."""
    rows, flat, n = _flat(ids)
    words = len(vocabulary)
    unseen = np.zeros((n, len(names)))
    weights = np.zeros((len(names), words + len(names)))
    for c in range(len(names)):
        told = ~np.isnan(labels[:, c])
        for k in range(FOLDS):
            keep = (folds != k) & told
            w = _regress(*_taken(rows, flat, keep), unseen[keep, :c], labels[keep, c], words)
            out = folds == k
            r, i = _taken(rows, flat, out)
            unseen[out, c] = _sigmoid(np.bincount(r, w[i], int(out.sum())) + unseen[out, :c] @ w[words:-1] + w[-1])
        w = _regress(*_taken(rows, flat, told), unseen[told, :c], labels[told, c], words)
        weights[c, : words + c], weights[c, -1] = w[:-1], w[-1]
    toxic, p = labels[:, -1] > 0, unseen[:, -1]
    score = lambda t: 2 * (toxic & (p >= t)).sum() / max(1, toxic.sum() + (p >= t).sum())
    return Chain(names, vocabulary, weights, max((0.2, 0.3, 0.4, 0.5, 0.6, 0.7), key=lambda t: (round(score(t), 3), -abs(t - 0.5))))


def _words(text: str | None) -> set[str]:
    found = set(WORD.findall(text.lower())) if text else set()
    return found.union(*[{w[:n] for w in found} for n in PREFIXES])


def fit(docs: DataFrame, labels: DataFrame, *, chain: tuple[str, ...] = ("low_quality", "toxic"), sample: int = SAMPLE) -> Chain:
    """labels: doc_id and a 0/1 column for each category of the chain."""
    spark = docs.sparkSession
    empty = Chain(chain, {}, np.zeros((len(chain), len(chain))), 0.5)
    last = chain[-1]
    known = labels.where(F.col("doc_id").isNotNull() & F.col(last).isNotNull()).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(f"is_{c}") for c in chain])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.array(*[f"is_{c}" for c in chain]).alias("told"), F.col(f"is_{last}").alias("toxic"))
    # SAMPLE rows of a few numbers: small whatever the input
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("told").alias("told"), F.max("toxic").alias("toxic"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(k, 200) for batch in batches for k in range(0, batch.num_rows, 200)):
            found = [sorted(_words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), b.column(2), b.column(3)], ["doc_id", "words", "told", "toxic"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    met = saved(texts.mapInArrow(words_of, f"doc_id {id_type}, words array<string>, told array<int>, toxic int"), "labelled")
    n, positive = met.agg(F.count("*"), F.sum("toxic")).first()
    if not positive or positive == n:
        return empty
    per_word = met.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos")).where(F.col("df") >= LEAST)
    share = positive / n
    expected = F.col("df") * share
    chi = F.pow(F.col("pos") - expected, 2) / expected + F.pow(F.col("pos") - expected, 2) / (F.col("df") * (1 - share))
    vocabulary = {r.word: i for i, r in enumerate(per_word.orderBy(chi.desc(), "word").limit(WORDS).collect())}
    if not vocabulary:
        return empty
    shared = spark.sparkContext.broadcast(vocabulary)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            ids = [np.array(sorted(place[w] for w in x if w in place), np.int32).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), b.column(2)], ["doc_id", "ids", "told"])

    rows = met.mapInArrow(coded, f"doc_id {id_type}, ids binary, told array<int>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))).orderBy("doc_id").collect()
    labels_of = np.array([[np.nan if x is None else x for x in r.told] for r in rows], float)
    return fit_chain(chain, vocabulary, [np.frombuffer(r.ids, np.int32).astype(np.int64) for r in rows], labels_of, np.array([r.fold for r in rows]))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, toxic (1 or 0) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        place = chain.vocabulary
        known = place.keys()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [np.array([place[w] for w in _words(t) & known], np.int64) for t in part.column(1).to_pylist()]
                p = np.round(chain.predict(ids), 9)
                toxic = chain.rejects(ids, p).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, c]) for c in range(len(names))], pa.array(toxic)], ["doc_id", *names, "toxic"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{x} double" for x in names) + ", toxic int")


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that the chain doesn't reject, unchanged, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        place = chain.vocabulary
        known = place.keys()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [np.array([place[w] for w in _words(t) & known], np.int64) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(~chain.rejects(ids, np.round(chain.predict(ids), 9))))

    return docs.mapInArrow(run, docs.schema)

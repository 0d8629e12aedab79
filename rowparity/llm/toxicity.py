"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier in numpy over the hashed words of a text.  It is
trained from texts that are confirmed toxic and from texts of which nothing
is known.  The unlabelled texts' risk as negatives is corrected by the class
prior: the part that toxic texts among them contribute is the prior times the
positives' risk as negatives.  Where that estimate falls below zero the model
has begun to fit the noise; the step then goes back up (non-negative risk).

The training sample is bounded by ``POSITIVES`` and ``UNLABELLED``; they are
the rows with the least hash of their id.  Every text is scored as a whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most training texts of each kind.
POSITIVES, UNLABELLED = 4_000, 16_000
#: How far, in log odds, scores may be shifted so that the prior's share of the unlabelled texts lies above one half.
MOST_SHIFT = 1.25
#: Hash buckets of words.
BUCKETS = 1 << 20
#: Words kept with their weights in a Python worker; then it starts afresh.
WORD_CACHE = 300_000
MARKS = b".,;:!?\"'()[]{}"


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def words_of(text: bytes) -> set[bytes]:
    """The different words of a text, lower-cased, without marks around them."""
    return {w.strip(MARKS) for w in set(text.lower().split())} - {b""}


def _features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the rows' texts, and where each text's begin.  The rows are bounded."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted({zlib.crc32(w) % BUCKETS for w in words_of(t or b"")}) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["words"])

    found = rows.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "words array<int>").toArrow()["words"].to_pylist()
    found = [w for w in found if w]
    lengths = np.array([len(w) for w in found], np.int64)
    return np.concatenate([np.zeros(0, np.int32), *(np.array(w, np.int32) for w in found)]), np.cumsum(lengths) - lengths


def fit(positive, unlabelled, prior: float, steps: int = 200, rate: float = 0.05, least: int = 5) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by full-batch Adam on the non-negative risk.

    ``positive`` and ``unlabelled`` are (buckets, begins).  Buckets in fewer
    than ``least`` texts keep the weight 0, and each step draws weights
    towards 0 (a lasso, stronger for fewer positives), so that words which
    tell nothing weigh nothing in long texts.  Without positive or unlabelled
    texts all weights are 0 and the bias says the prior.
    """
    weights = np.zeros(BUCKETS)
    prior = min(max(prior, 1e-4), 0.9999)
    bias = float(np.log(prior / (1 - prior)))
    if not len(positive[1]) or not len(unlabelled[1]):
        return weights, bias
    df = np.bincount(positive[0], minlength=BUCKETS) + np.bincount(unlabelled[0], minlength=BUCKETS)
    used = np.flatnonzero(df >= least)
    place = np.full(BUCKETS, len(used))
    place[used] = np.arange(len(used))
    sides = []
    for buckets, begins in (positive, unlabelled):
        column, row = place[buckets], np.repeat(np.arange(len(begins)), np.diff(begins, append=len(buckets)))
        sides.append((column[column < len(used)], row[column < len(used)], len(begins)))
    (xp, rp, n_positive), (xu, ru, n_unlabelled) = sides
    lasso = min(max(0.1 / n_positive, 1e-4), 3e-3)
    w, m, v = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        zp, zu = np.bincount(rp, w[xp], n_positive) + bias, np.bincount(ru, w[xu], n_unlabelled) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = (prior * (sp - 1) - prior * sp) / n_positive, su / n_unlabelled
        else:
            gp, gu = prior * sp / n_positive, -su / n_unlabelled
        grad = np.append(np.bincount(xp, gp[rp], len(w)) + np.bincount(xu, gu[ru], len(w)), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        move = rate * m / (1 - 0.9**step) / scale
        w, bias = w - move[:-1], bias - float(move[-1])
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso / scale[:-1], 0)
    # the lasso shrinks scores; the prior says how many unlabelled texts lie above 0
    z = np.bincount(ru, w[xu], n_unlabelled) + bias
    bias -= float(np.clip(np.quantile(z, 1 - prior), -MOST_SHIFT, MOST_SHIFT))
    weights[used] = w
    return weights, bias


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of the documents with these ids, a text for each id and in their order, so that a model can be made again.

    Of several texts with one id that with the least hash counts.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").select("text")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Fits the classifier; only labels of rows whose fold isn't 0 are read.

    The prior is the share of toxic rows among those labels.
    """
    seen = labels.select("doc_id", "toxic").where((fold("doc_id") != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    prior = seen.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    by_hash = [F.xxhash64("doc_id", F.lit(5)), "doc_id"]
    ids = seen.where("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(positives)
    positive = _texts(docs, ids)
    others = docs.where((fold("doc_id") != 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*by_hash).limit(unlabelled)
    rest = _texts(docs, others)
    return fit(_features(positive), _features(rest), prior)


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; empty and null texts score by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    class Weights(dict):
        """Weights by raw word; words whose letters are marks alone weigh nothing."""

        def __missing__(self, word: bytes) -> tuple[bytes, float]:
            bare = word.strip(MARKS)
            self[word] = found = (bare, float(shared.value[0][zlib.crc32(bare) % BUCKETS]) if bare else 0.0)
            return found

    def run(batches):
        weights, bias = Weights(), shared.value[1]
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                found = {weights[w] for w in set(text.lower().split())} if text else ()
                out.append(bias + sum(w for _, w in found if w))
                if len(weights) > WORD_CACHE:
                    weights.clear()
            score = 1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold("doc_id") == 0).alias("held_out"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on ``labels`` and scores every document of ``docs``; see ``train`` and ``scored``.

    Equal rows get equal scores.  Labels without a document and documents
    without a label are fine; without any toxic label all texts score the
    same, and an empty table gives an empty one.
    """
    return scored(docs, train(docs, labels))


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

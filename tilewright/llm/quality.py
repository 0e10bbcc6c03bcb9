"""Quality classifier: logistic regression over hashed word n-grams, learnt with FTRL-proximal updates.

The features of a text are its word 1- and 2-grams, the 1- to 3-grams of its words' shapes (which kinds of
characters a word has, as a backed-off form of the word) and whether neighbouring words repeat. A feature's value is
its share of all features of the text, so the logit is the intercept plus ``SCALE`` times the mean weight: one sparse
dot product per text, evaluated for a whole Arrow slice at once.

Edge cases: a null or empty text has no features and gets the intercept's score; rows that repeat get the same score;
null ids are scored and are in no held-out fold; an empty table gives no rows; without usable labels every score is
that of the starting intercept (0.5). Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import words as W
from tilewright.llm.ftrl import Ftrl, bounded_sample, fit, held_out_fold, map_scored, sigmoid
from tilewright.plans.storage import bound_batches, discard, materialize

#: Labelled rows used for fitting at most (in expectation), and the number of shards they are learnt in.
SAMPLE_BOUND, SHARDS = 12_000, 8
SCALE = 30.0
FTRL = Ftrl(bits=18, alpha=1.0, l1=0.02, l2=0.01)

_UPPER, _LOWER, _DIGIT, _OTHER = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT[48:58] = 1
_OTHER[33:128] = 1
_OTHER[:128] -= (_UPPER + _LOWER + _DIGIT)[:128]
_OTHER[:33] = 1


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word from the kinds of characters it has and its last byte, if that is no letter."""
    out = np.minimum(ends - starts, 12) // 3
    for table, most in ((_UPPER, 2), (_LOWER, 2), (_DIGIT, 3), (_OTHER, 3)):
        total = np.concatenate([[0], np.cumsum(table[data])])
        out = out * (most + 1) + np.minimum(total[ends] - total[starts], most)
    last = data[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    return W.mix((out * 256 + np.where(_LOWER[last] + _UPPER[last] > 0, 0, last)).astype(np.uint64))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (feature numbers, how many each row has)."""
    starts, ends, counts = W.words(data, offsets)
    word, shape = W.span_hashes(data, starts, ends), _shapes(data, starts, ends)
    same, row = np.zeros(len(word), np.uint64), np.repeat(np.arange(len(counts)), counts)
    for k in (1, 2):
        same[k:] += ((word[k:] == word[:-k]) & (row[k:] == row[:-k])).astype(np.uint64) * np.uint64(k)
    groups = [W.ngrams(word, counts, n) for n in (1, 2)] + [W.ngrams(shape, counts, n) for n in (1, 2, 3)] + [(same, counts)]
    return [((W.mix(h + np.uint64(1 + 977 * g)) >> np.uint64(64 - bits)).astype(np.int64), c) for g, (h, c) in enumerate(groups)]


def learn(z: np.ndarray, n: np.ndarray, shard: pa.Table, ftrl: Ftrl = FTRL) -> None:
    y, row = shard.column("y").to_numpy(), 0
    for _, _, data, offsets in W.slices(shard.column("text").combine_chunks()):
        groups = features(data, offsets, ftrl.bits)
        ends = [np.concatenate([[0], np.cumsum(c)]) for _, c in groups]
        for r in range(len(offsets) - 1):
            at, times = np.unique(np.concatenate([f[e[r] : e[r + 1]] for (f, _), e in zip(groups, ends, strict=True)]), return_counts=True)
            x = SCALE * times / max(1, times.sum())
            at, x = np.append(at, len(z) - 1), np.append(x, 1.0)
            w = ftrl.weights(z[at], n[at])
            ftrl.update(z, n, at, w, (sigmoid(w @ x) - y[row]) * x)
            row += 1


def score_texts(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, data, offsets in W.slices(column):
        groups = features(data, offsets, bits)
        sums = sum(W.row_sums(weights[f], c) for f, c in groups)
        out[i:j] = sigmoid(weights[-1] + SCALE * sums / np.maximum(1, sum(c for _, c in groups)))
    return np.round(out, 9)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, bound: int = SAMPLE_BOUND, ftrl: Ftrl = FTRL) -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out fold."""
    sample = materialize(bounded_sample(docs, labels, label, folds, held_out, bound, SHARDS))
    weights = fit(sample, ftrl, lambda z, n, t: learn(z, n, t, ftrl), bias=0.0)
    discard(sample)
    return weights


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), bits: int = FTRL.bits) -> DataFrame:
    """The columns ``keep`` and ``score``, for each row."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    plain = docs.select(*keep, F.col("text").alias("_text"))
    schema = plain.drop("_text").schema.add("score", "double")
    return plain.mapInArrow(map_scored(lambda t: {"score": pa.array(score_texts(t, held.value, bits))}), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of each row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return score(packed, train(docs, labels), ("_row",)).where("score >= 0.5").select("_row.*")

"""Toxicity by multiple-instance learning: documents are bags of sentences, labels are known for documents only.

A sentence's score is a logistic function of its hashed words (letters and digits, lower case) and of how these begin,
which carries over to words that were never seen. A document's score is the noisy-or of them, 1 - prod(1 - s), and its log-loss is passed down to the sentences, so
training on document labels teaches which sentences offend. FTRL updates with L1 keep the words that matter: a
document's slopes sum to about 1 at most in a round, so features of one document hardly get a weight.

The noisy-or's odds are then divided by a constant, so that 0.5 is the cut at which the labelled rows of the sample are
told apart best (the mean of both classes' shares that are right).

Sentences end at ``.``, ``!``, ``?`` or a line feed. Edge cases: a text without words has no sentence and gets the
empty noisy-or, 0; nulls count as empty; rows that repeat get the same score; null ids are scored and are in no
held-out fold; an empty table gives no rows; without usable labels no sentence is found toxic. Other columns are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import words as W
from tilewright.llm.ftrl import Ftrl, bounded_sample, fit, held_out_fold, map_scored, sigmoid
from tilewright.plans.storage import bound_batches, discard, materialize

#: Labelled rows used for fitting at most (in expectation), and the number of shards they are learnt in.
SAMPLE_BOUND, SHARDS = 8_000, 4
FTRL = Ftrl(bits=18, alpha=3.0, l1=2.0, l2=0.0)
BIAS = -6.0
#: Rounds of learning, and steps of calibration: an eighth of a unit of log-odds, from -REACH to REACH.
ROUNDS, STEP, REACH = 5, 8, 20
#: Bytes of the beginnings that are features of longer words.
PREFIXES = (4, 5, 6, 8)

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Feature groups by sentence, sentences in each row, and each sentence's first and last byte offset in its row."""
    starts, ends, counts = W.words(data, offsets, _TOKEN)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    row = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] != stops[ends[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(starts)))
    per_row = np.bincount(row[first], minlength=len(counts))
    of, lower = np.repeat(np.arange(len(first)), sizes), W.LOWER[data]
    groups = []
    for k in (0, *PREFIXES):
        some = np.flatnonzero(ends - starts > k)
        h = W.span_hashes(lower, starts[some], starts[some] + k if k else ends[some], k)
        groups.append(((h >> np.uint64(64 - bits)).astype(np.int64), np.bincount(of[some], minlength=len(first))))
    base = offsets[:-1][row[first]] if len(first) else np.zeros(0, np.int64)
    return groups, per_row, starts[first] - base, (ends[first + sizes - 1] - base if len(first) else base)


def learn(z: np.ndarray, n: np.ndarray, shard: pa.Table, ftrl: Ftrl = FTRL) -> None:
    """One pass over the documents in order; a feature counts once in a sentence."""
    y, k = shard.column("y").to_numpy(), 0
    for _, _, data, offsets in W.slices(shard.column("text").combine_chunks()):
        groups, per_row, _, _ = sentences(data, offsets, ftrl.bits)
        cut = np.concatenate([[0], np.cumsum(per_row)])
        ends = [np.concatenate([[0], np.cumsum(c)]) for _, c in groups]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            label, size, k = y[k], b - a, k + 1
            if not size:
                continue
            at = np.concatenate([f[e[a] : e[b]] for (f, _), e in zip(groups, ends, strict=True)])
            of = np.concatenate([np.repeat(np.arange(size), c[a:b]) for _, c in groups])
            once = np.unique(at * size + of)
            of = once % size
            own, back = np.unique(once // size, return_inverse=True)
            w = ftrl.weights(z[own], n[own])
            bias = ftrl.weights(z[-1:], n[-1:])[0]
            s = sigmoid(bias + np.bincount(of, w[back], size))
            rest = np.exp(np.log1p(-np.minimum(s, 1 - 1e-9)).sum())
            slope = -s * rest / max(1e-6, 1 - rest) if label else s
            ftrl.update(z, n, own, w, np.bincount(back, slope[of], len(own)))
            ftrl.update(z, n, np.array([len(z) - 1]), np.array([bias]), np.clip(slope.sum(keepdims=True), -1, 1))


def _score(column: pa.Array, weights: np.ndarray, cut: float, bits: int) -> dict[str, pa.Array]:
    score, count = np.zeros(len(column)), np.zeros(len(column), np.int64)
    spans: list[list[dict]] = [[] for _ in range(len(column))]
    for i, j, data, offsets in W.slices(column):
        groups, per_row, first, last = sentences(data, offsets, bits)
        logit = np.full(len(first), float(weights[-1]))
        for f, c in groups:
            of = np.repeat(np.arange(len(first)), c)
            live = np.flatnonzero(weights[f])  # L1 leaves few; a feature counts once in a sentence
            pairs = np.unique(of[live] * (1 << bits) + f[live])
            logit += np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], len(first))
        s = sigmoid(logit)
        none = np.exp(W.row_sums(np.log1p(-np.minimum(s, 1 - 1e-9)), per_row))
        score[i:j] = (1 - none) / (1 - none + none * np.exp(cut))
        found = logit >= cut
        count[i:j] = W.row_sums(found, per_row).astype(np.int64)
        row = np.repeat(np.arange(i, j), per_row)
        for k in np.flatnonzero(found):
            spans[row[k]].append({"start": int(first[k]), "end": int(last[k]), "score": round(float(s[k]), 6)})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return {"score": pa.array(np.round(score, 9)), "n_offending": pa.array(count), "offending": pa.array(spans, kind)}


@dataclass(frozen=True)
class Model:
    """Weights of the sentences' features, and the log-odds of the noisy-or at which a document counts as toxic."""

    weights: np.ndarray
    cut: float


def best_cut(counts: np.ndarray) -> float:
    """The log-odds that tell the classes apart best, from the counts (negative, positive) of each step.

    Of equally good ones the middle one; without both classes, 0."""
    total = counts.sum(0)
    if not total.all():
        return 0.0
    below = np.concatenate([np.zeros((1, 2)), np.cumsum(counts, 0)]) / total
    right = below[:, 0] + 1 - below[:, 1]
    best = np.flatnonzero(right > right.max() - 1e-9)
    return float(best[len(best) // 2] / STEP - REACH)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, bound: int = SAMPLE_BOUND, ftrl: Ftrl = FTRL) -> Model:
    """A model learnt from labelled rows outside the held-out fold."""
    sample = materialize(bounded_sample(docs, labels, label, folds, held_out, bound, SHARDS))
    model = Model(fit(sample, ftrl, lambda z, n, t: learn(z, n, t, ftrl), bias=BIAS, rounds=ROUNDS), 0.0)
    odds = F.ln(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    step = F.floor((F.least(F.greatest(odds, F.lit(-REACH)), F.lit(REACH - 1e-6)) + REACH) * STEP).cast("int")
    counts = np.zeros((2 * REACH * STEP, 2))
    for k, y, n in score(sample, model, ("y",), ftrl.bits).groupBy(step.alias("k"), "y").count().collect():
        counts[k, y] += n
    discard(sample)
    return Model(model.weights, best_cut(counts))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), bits: int = FTRL.bits) -> DataFrame:
    """``keep``, the document's score, and its offending sentences as byte spans with their scores."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cut))
    plain = docs.select(*keep, F.col("text").alias("_text"))
    schema = plain.drop("_text").schema.add("score", "double").add("n_offending", "long")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", offending array<struct<start: bigint, end: bigint, score: double>>"
    return plain.mapInArrow(map_scored(lambda t: _score(t, *held.value, bits)), fields)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on), n_offending, and the offending spans of each row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "offending")

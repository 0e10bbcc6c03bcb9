"""Follow-the-regularised-leader (proximal, per coordinate) updates, and mixing of learners trained on shards.

The state is two arrays over 2**bits hashed features: ``z`` (adjusted gradient sums) and ``n`` (squared gradient
sums). Shards of a bounded training sample are learnt by separate tasks from the same starting state; the states
are then averaged by Spark and the next round starts from the mean. Only these states, whose size is fixed by
``bits``, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import words as W


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, z: np.ndarray, n: np.ndarray, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step for the distinct coordinates ``at`` with weights ``w`` and gradient ``g``."""
        old = n[at]
        new = old + g * g
        z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        n[at] = new


#: Entries of the state that travel together.
BLOCK = 1 << 12
_STATE = "block int, z array<float>, n array<float>"

#: learn(z, n, table) runs over one shard in place; the table has the columns ``y`` and ``text`` in a fixed order.
Learn = Callable[[np.ndarray, np.ndarray, pa.Table], None]


def fit(sample: DataFrame, ftrl: Ftrl, learn: Learn, bias: float, rounds: int = 3) -> np.ndarray:
    """Weights from ``sample`` (doc_id, shard, y, text); the last entry is the intercept, ``bias`` at the start.

    States travel as arrays of ``BLOCK`` entries, and Spark averages the shards' blocks. An empty sample gives zero
    weights and that intercept. ``sample`` is read once a round, so it should be a written table."""
    size = (1 << ftrl.bits) + 1
    z, n = start_state(ftrl, bias)
    for _ in range(rounds):
        start = sample.sparkSession.sparkContext.broadcast((z, n))

        def one(table: pa.Table) -> pa.Table:
            own_z, own_n = (x.astype(np.float64) for x in start.value)
            learn(own_z, own_n, table.sort_by([("doc_id", "ascending"), ("text", "ascending")]))
            return _blocks(own_z, own_n)

        states = sample.groupBy("shard").applyInArrow(one, _STATE)
        mean = states.groupBy("block").applyInArrow(_mean, _STATE).toArrow().sort_by("block")
        start.unpersist()
        if not mean.num_rows:
            break
        z, n = (mean.column(c).combine_chunks().flatten().to_numpy()[:size] for c in ("z", "n"))
    return ftrl.weights(z.astype(np.float64), n.astype(np.float64))


def start_state(ftrl: Ftrl, bias: float) -> tuple[np.ndarray, np.ndarray]:
    z, n = (np.zeros((1 << ftrl.bits) + 1, np.float32) for _ in range(2))
    n[-1] = 1.0
    z[-1] = -bias * ((ftrl.beta + 1.0) / ftrl.alpha + ftrl.l2) - np.sign(bias) * ftrl.l1
    return z, n


def _blocks(z: np.ndarray, n: np.ndarray) -> pa.Table:
    count = -(-len(z) // BLOCK)
    padded = [np.zeros(count * BLOCK, np.float32) for _ in range(2)]
    for out, x in zip(padded, (z, n), strict=True):
        out[: len(x)] = x
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * BLOCK), pa.array(x)) for x in padded]
    return pa.table({"block": pa.array(np.arange(count, dtype=np.int32)), "z": lists[0], "n": lists[1]})


def _mean(table: pa.Table) -> pa.Table:
    """One block of the mean of the shards' states."""
    table = table.combine_chunks()
    means = [table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, BLOCK).mean(0, dtype=np.float64).astype(np.float32) for c in ("z", "n")]
    return pa.table({"block": table.column("block").slice(0, 1), "z": pa.array([means[0]], pa.list_(pa.float32())), "n": pa.array([means[1]], pa.list_(pa.float32()))})


def bounded_sample(docs: DataFrame, labels: DataFrame, y: str, folds: int, held_out: int, bound: int, shards: int, id_col: str = "doc_id") -> DataFrame:
    """About ``bound`` labelled rows at most, outside the held-out fold, chosen by a hash of the id.

    The ids are counted, and the share that is kept is bound / count; they are few enough to broadcast. Rows with
    a label other than 0 and 1, a null id or a null text teach nothing."""
    ids = labels.where(F.col(y).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % folds != held_out))
    ids = ids.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(y)).alias("y"))
    found = ids.count()
    share = min(1.0, bound / max(1, found))
    ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"), F.col("y").cast("int").alias("y"), "text")


def held_out_fold(id_col: str, folds: int, fold: int):
    """Whether crc32(id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def map_scored(score: Callable[[pa.Array], dict[str, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: keeps all columns but the last, a text, and adds what ``score`` makes of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {batch.schema.names[i]: batch.column(i) for i in range(batch.num_columns - 1)}
            yield pa.RecordBatch.from_pydict(columns | score(batch.column(batch.num_columns - 1)))

    return W.giving_back(run)

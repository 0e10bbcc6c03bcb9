"""Tables that cut lineage, written to the folder which every executor shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Seconds between two requests to collect garbage.
RELEASE_S = 5.0


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a fresh local one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark.sparkContext, "_tilewright_dir", None):
        own = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext.setCheckpointDir(own)
        spark.sparkContext._tilewright_dir = own
        atexit.register(_remove_local, own)
    return spark.sparkContext._tilewright_dir


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and lost executors
    only lose running tasks. ``discard`` removes the files once nothing reads them any more."""
    path = f"{shared_dir(df.sparkSession)}/tilewright-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tilewright_path = path
    release(df.sparkSession)
    return back


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark removes them once the JVM has collected their plans, for
    which a large heap may wait very long. The second collection takes the last step's plan, which listeners may still
    hold during the first. Not more often than every ``RELEASE_S`` seconds."""
    now = time.monotonic()
    if now - getattr(spark.sparkContext, "_tilewright_released", -RELEASE_S) >= RELEASE_S:
        gc.collect()
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
        spark.sparkContext._tilewright_released = time.monotonic()


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned."""
    for df in frames:
        path = getattr(df, "_tilewright_path", None)
        if path:
            remove(df.sparkSession, path)
            df._tilewright_path = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold ``BATCH_BYTES`` at most where the session keeps Spark's default of 64 MB: both
    the JVM and the Python worker hold a batch several times over."""
    if spark.conf.get(_BYTES) in ("64MB", "67108864b", str(1 << 26)):
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

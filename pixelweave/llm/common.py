"""Shared helpers of the training-data operators: shared storage, word splitting, hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Java/SQL whitespace class used by every contract here: ASCII space and 0x09 to 0x0D, as bytes.split() has it.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local master gets a temporary one where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        top = tempfile.mkdtemp(prefix="pixelweave-")
        spark.sparkContext.setCheckpointDir(top)
        top = "file://" + top
    return top.rstrip("/")


def run_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders of intermediate tables that this process has written and not removed.
_written: list[str] = []


def remove(paths: list[str]) -> None:
    """Remove folders of intermediate tables."""
    context = SparkContext._active_spark_context
    for path in paths:
        if context is not None:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        elif path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        if path in _written:
            _written.remove(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Intermediate tables written inside are removed at the end, but for the folders put in the list."""
    before, keep = set(_written), []
    try:
        yield keep
    finally:
        remove([x for x in _written if x not in before and x not in keep])


@atexit.register
def _remove_all() -> None:
    try:
        remove(list(_written))
    except Exception:  # the session's virtual machine may be gone already
        return


def materialize(df: DataFrame, what: str, keep: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. keep: gets the folder's name."""
    spark = df.sparkSession
    path = run_dir(spark, what)
    _written.append(path)
    if keep is not None:
        keep.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, name: str = "__row") -> Column:
    """All columns of a table as one, so that no name clashes; ``unpacked`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def unpacked(docs: DataFrame, name: str = "__row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in docs.columns]


def more_partitions(df: DataFrame, each: int, most: int = 200_000) -> list[int]:
    """The number of partitions for a shuffle of a whole table by the size of its largest source, if it is above the session's; else none, so
    that Spark may put small ones together."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = max((x for x in sizes if x < 1 << 60), default=0)  # a plan's own estimate multiplies them; sources that tell no size have a huge one
    wanted = min(most, -(-size // each))
    return [wanted] if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


#: Keys that are joined by broadcast because they hold the most rows: so many at most.
HOT_KEYS = 10_000


def join_hot(left: DataFrame, right: DataFrame, keys: str | list[str], total: int, count: str = "n", least: int = 1000) -> DataFrame:
    """left joined with right, of one row a key, whose column ``count`` (dropped) tells the left rows of the key out of total.

    Keys with more than total / HOT_KEYS rows, and ``least`` (so at most HOT_KEYS of them) are broadcast, and their rows never shuffled; no
    partition gets more of one key than that share.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    most = max(least, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(count) > most).drop(count))
    cold = right.where(F.col(count) <= most).drop(count)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return left.join(hot, keys).unionByName(rest)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError, TypeError):  # another C library
    _trim = None
#: What a worker holds from task to task, by the name of its owner: functions that let go of it.
_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, let_go: Callable[[], None]) -> None:
    """Says that this worker now holds something between tasks of the owner."""
    _held[owner] = let_go


def working(owner: str) -> None:
    """Called at the start of a task: a worker that now does something else lets go of what others hold in it, and memory that the tasks
    before have freed goes back to the system."""
    for other in [x for x in _held if x != owner]:
        _held.pop(other)()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Values of a string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: int, most: int = 4 << 20):
    """Slices of a batch with at most so many bytes of text each (one row at least), to bound memory."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hash of every k consecutive values (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)

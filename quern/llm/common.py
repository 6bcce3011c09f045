"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every contract of this package counts them: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_held: ContextVar[list[str] | None] = ContextVar("held", default=None)
_memos: dict = {}


def hold_memo(owner: str, forget) -> None:
    """Say that an operator now remembers things in this worker; others forget theirs.

    Workers go from stage to stage of a pipeline, and hold one operator's memory at a time.
    What the one before has freed goes back to the machine.
    """
    if not _memos and (set_up := getattr(ctypes.CDLL(None), "mallopt", None)) is not None:  # of glibc
        set_up(-3, 1 << 20)  # arrays of a megabyte or more are mapped on their own, and go back when they are freed
    others = [n for n in _memos if n != owner]
    for name in others:
        _memos.pop(name)()
    _memos[owner] = forget
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where the
    session has none and all runs on one machine, as in tests, is a temporary folder set;
    on a cluster executors would write to their own disks there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def hold_scratch(paths: list[str]):
    """Add the scratch tables that are made inside to a list, so that their owner can delete them."""
    token = _held.set(paths)
    try:
        yield
    finally:
        _held.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder, which may go when the application has ended.

    Results are lazy and read these tables, so nothing deletes them before but an owner
    that has the result written (hold_scratch).
    """
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    if (held := _held.get()) is not None:
        held.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends at the written files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that holds more than one row in so many is hot; so there are never more hot keys than this.
HOT_SHARE, HOT_ROWS = 1000, 2000


def join_hot(rows: DataFrame, by_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with by_key, which has one row for each key and the number of rows that it holds.

    Hot keys, at most HOT_SHARE of them whatever the input, are joined by broadcast, so
    their rows stay where they are; the others are shuffled. rows is read twice, so it
    should be a written table. total: the sum of the counts, or more.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    other = by_key.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in by_key.columns if c not in keys])
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) if same is None else same & (F.col(k) == F.col(f"_{k}"))
    hot, cold = other.where(F.col(count) > limit), other.where(F.col(count) <= limit)
    names = [f"_{k}" for k in keys]
    fast = rows.join(F.broadcast(hot), same).drop(*names)
    slow = rows.join(F.broadcast(hot.select(*names)), same, "left_anti").join(cold.hint("merge"), same).drop(*names)
    return fast.unionByName(slow)

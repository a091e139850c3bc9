"""What the operators need of the session: the shared folder, checkpoints and a partition count."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes that one shuffle partition should stand for.
PARTITION_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lakesieve-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def cut(df: DataFrame, what: str = "table", keep: bool = False) -> DataFrame:
    """`df` as a table written to the shared folder: executors that are lost later don't matter. With `keep`, it outlives `scratch`."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut meanwhile are deleted at the end, but for those to keep: what is returned must not read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that `df` holds."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for `df`: what the session says, or more where the input asks for it."""
    said = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(said, math.ceil(size / PARTITION_BYTES) if size < 1 << 60 else 0, 1)


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20):
    """Meanwhile, keeps what Spark hands to Python at once below `most` bytes, where rows are blocks of documents; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    now = int(str(old).rstrip("bB"))
    try:
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
        yield
    finally:
        spark.conf.set(key, old)


def give_back() -> None:
    """Returns freed memory to the system, where its C library can: Python workers live on between stages, several beside each other."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """`run`, which maps record batches, and then `give_back`."""

    def held(batches):
        yield from run(batches)
        give_back()

    return held


def free_name(taken, base: str) -> str:
    """`base`, with underscores in front until no column has that name (in any case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def lower_ascii(col):
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""What the operators share: a folder all executors see, written tables, bounded joins."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch, shared_dir, written

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACES", "WORD", "bound_batches", "return_memory", "rows_with_ids", "scratch", "settle", "shared_dir", "table", "tidy"]

#: Ids are sent to every executor only if they were counted and are at most so many (8 MB of longs).
MOST_BROADCAST_IDS = 1_000_000


#: Rows that a task sends to Python at once take about so many bytes (one row at least).
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` from here on, unless the session has a bound of its own.

    10,000 whole texts at once are held by the executor outside its heap, twice while they
    grow, and by the Python worker again; all rows still pass, in more batches.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    return written(df, name)


def return_memory() -> None:
    """Give back what Arrow and the C library keep for later; a reused Python worker would hold it for hours."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function for ``mapInArrow`` after which each task returns its memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            return_memory()

    return tidied


def rows_with_ids(docs: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (or with ``left_anti`` is not) in ``ids``, a written table of one column.

    The ids are counted first; only up to ``MOST_BROADCAST_IDS`` of them are broadcast,
    beyond that the join shuffles both sides and Spark may split skewed partitions.
    """
    small = ids.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, column, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

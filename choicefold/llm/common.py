"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a table that may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else (tests) a local one that is set here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="choicefold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/choicefold/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors, so that it is made once; what a lost executor held is made again from the inputs.

    For small tables that several jobs read; unlike :func:`stored` it makes no files.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of ours that no returned result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that an operator needs only until its result is stored: leaving the block frees them all.

    ``kept`` and ``stored`` work as the functions of these names.  A lazy result must not read any of them; what it reads
    is made outside (or after) the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._kept, self._paths = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        for path in self._paths:
            drop_path(self.spark, path)

    def kept(self, df: DataFrame) -> DataFrame:
        self._kept.append(kept(df))
        return df

    def adopt(self, other: Scratch) -> None:
        """Free with this one what the other holds."""
        self._kept, self._paths = self._kept + other._kept, self._paths + other._paths

    def free(self, df: DataFrame) -> None:
        """Let one kept table go before the end."""
        self._kept = [x for x in self._kept if x is not df]
        df.unpersist()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _stored(df, name)
        self._paths.append(path)
        return out


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name already (in any case), and unlike each other."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for a broadcast only if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= most else df


def give_back() -> None:
    """Free memory of this worker goes back to the machine: workers are kept and used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Free heap of the executors goes back to the machine: after steps inside the JVM it is grown to its limit, and Python workers need room beside it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def runs(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows with about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            upto = int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), side="right"))
            upto = max(start + 1, upto)
            yield batch.slice(start, upto - start)
            start = upto
        give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """:func:`runs` with the texts as strings; null becomes ''."""
    for batch in runs(batches, column, most):
        yield batch, [x or "" for x in batch.column(column).to_pylist()]

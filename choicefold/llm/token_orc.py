"""Token ids in ORC: run-length encoded stripes, row indexes, Bloom filters on document ids.

Layout: one folder of ORC files in ascending ``doc_id`` (nulls first).  Each row is a
document: ``doc_id``, ``local_start`` (ids before it in its file), ``n_tokens``,
``ids`` (array of int, which ORC stores by its integer run-length encoding).  Stripes are
read in parallel; statistics of stripes and row groups and the Bloom filters let
:func:`lookup` skip what can't hold an id.

Null or empty text: the end id alone.  Repeated ``doc_id``: a row each, next to
each other in order of their texts, so that reruns agree.  Very long texts are one row.  Other columns play no part.  One task writes one
file: ``maxRecordsPerFile`` is set to 0 here, since ``local_start`` counts within a file.  An empty table: an empty folder, read back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, runs
from .tokens import encoder

SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, keep_space: bool = True) -> None:
    """Encode every whole text, append ``end_id`` and write the files of the module's layout to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(vocabulary, keep_space), 0
        for batch in runs(batches, "text"):
            ids, per = enc.encode(batch.column("text"))
            ends = np.cumsum(per)
            ids = np.insert(ids, ends, end_id).astype(np.int32)
            per = per + 1
            ends = np.cumsum(per)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(before + ends - per), pa.array(per), lists], ["doc_id", "local_start", "n_tokens", "ids"])
            before += int(ends[-1])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document with ``start``, the ids of all documents before it in the whole folder."""
    rows = spark.read.schema(SCHEMA).orc(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    # A row per file: its place among the files is a running sum over that short table.
    files = rows.groupBy(part.alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    n_files = len(rows.inputFiles())
    joined = rows.withColumn("file", part).join(maybe_broadcast(files, n_files), "file")
    return joined.select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents; the filter reaches the ORC reader, which skips stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of the ids as little-endian unsigned 32-bit integers, instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

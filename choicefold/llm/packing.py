"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many of
the greatest length as fit, then the binary digits of the rest.  Equal lengths share a bucket, and
each piece is a sequence of its own, so no sequence crosses documents and none is padded.

Null or empty text: one piece, the end id.  Repeated rows: pieces each.  Sequence
ids are unique and the same in reruns over the same files; they are not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs
from .tokens import encoder

MOST = 2048
#: Bytes of text that a worker encodes at a time (one whole text at least); its arrays take some 40 times as much.
RUN_BYTES = 2_000_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]


def lengths(n: int, most: int = MOST) -> list[int]:
    """The pieces of n ids, longest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int, keep_space: bool = False, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """A row per piece; ``bucket`` is the exponent of its length. ``with_ids`` adds the ids themselves."""
    if most & (most - 1):
        raise ValueError("the greatest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, keep_space)
        for batch in runs(batches, "text", RUN_BYTES):
            ids, per = enc.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(per), end_id).astype("<u4")
            per = per + 1
            cuts = [lengths(n, most) for n in per.tolist()]
            of = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts])
            length = np.fromiter((x for c in cuts for x in c), np.int64, len(of))
            ends = np.cumsum(length)
            first = np.cumsum(per) - per
            crc = [zlib.crc32(ids[j - n : j]) for j, n in zip(ends.tolist(), length.tolist(), strict=True)]
            made = [batch.column("doc_id").take(pa.array(of)), ends - length - first[of], length, pa.array(crc, pa.int64()), per[of], np.log2(length).astype(np.int32)]
            out = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            if with_ids:
                out.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, NAMES + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))

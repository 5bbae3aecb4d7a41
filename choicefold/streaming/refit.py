"""Estimates that follow a stream of observations.

The batch engine has no stream semantics of its own; a stream of observations is appended to a
table, and every micro-batch ends in a refit over all rows so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.fit import Data, Model, estimate
from ..plans.results import FitResult
from ..sources.tables import numbered


def refit_stream(stream: DataFrame, table_path: str, checkpoint: str, model: Model, key: str, on_fit: Callable[[int, FitResult], None], **controls) -> StreamingQuery:
    """Starts the query. A batch that is run again replaces its own rows, so restarts change nothing."""
    spark = stream.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")
        rows = spark.read.parquet(table_path).drop("epoch")
        if rows.isEmpty():
            return
        # Ids are dense over all rows so far, so a cut's agent may be another one later: cuts can't be carried over, only theta can be compared.
        on_fit(epoch, estimate(model, Data(numbered(rows, rows[key])), **controls))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

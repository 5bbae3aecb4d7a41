"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, into: Scratch | None = None) -> DataFrame:
    """``id``, ``component`` (least id that can be reached) for every end of ``edges`` (a, b long, no nulls).

    Every round takes the least label among neighbours and then the label of that label, so
    chains shrink by halves; each round is written to the shared folder, and only the last one's table outlives the call (in
    ``into``, if given).  The join on a neighbour's label is split by AQE where one label has many neighbours; sums of labels are combined
    before they are shuffled.  No edges: no rows.
    """
    into = into or Scratch(edges.sparkSession)
    with Scratch(into.spark) as first:
        both = first.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
        begin = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component"))
        owner = Scratch(into.spark)
        now = owner.stored(begin, "cc")
        while True:
            near = both.join(now.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
            step = now.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
            jump = now.select(F.col("id").alias("c"), F.col("component").alias("of"))
            after_step = step.join(jump, "c").select("id", "old", F.least("c", "of").alias("component"))
            mine = Scratch(into.spark)
            after = mine.stored(after_step, "cc")
            changed = after.where(F.col("old") != F.col("component")).limit(1).count()
            owner.close()
            owner, now = mine, after.select("id", "component")
            if not changed:
                into.adopt(owner)
                return now

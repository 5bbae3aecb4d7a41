"""Dual measures on disk: one Parquet partition per replication, written once.

``rep_id`` / ``duals`` (agent_id, bundle_row_id, pi), ``bundles`` (bundle_row_id, bundle) and ``bounds`` (coord, value).
Any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = {"duals": "agent_id bigint, bundle_row_id bigint, pi double", "bundles": "bundle_row_id bigint, bundle array<double>", "bounds": "coord int, value double"}


class DualStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(self, rep_id: int, duals: DataFrame, bundles: DataFrame, bounds: DataFrame) -> None:
        """Writes one replication; its mark comes last, and one that is there already is an error."""
        if rep_id < 0:
            raise ValueError("rep_id must be at least 0")
        if self._exists(f"{self.path}/done/rep_id={rep_id}"):
            raise FileExistsError(f"replication {rep_id} is stored already")
        for name, df in zip(PARTS, (duals, bundles, bounds), strict=True):
            cols = [c.split()[0] for c in PARTS[name].split(", ")]
            df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/{name}/rep_id={rep_id}")
        self.spark.range(1).write.parquet(f"{self.path}/done/rep_id={rep_id}")

    def rep_ids(self) -> list[int]:
        if not self._exists(f"{self.path}/done"):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/done").select(F.col("rep_id").cast("int")).distinct().collect())

    def read(self, name: str) -> DataFrame:
        """One part of all replications, with ``rep_id``: a filter on it prunes partitions."""
        return self.spark.read.schema(f"{PARTS[name]}, rep_id int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def load(self, rep_id: int) -> dict[str, DataFrame]:
        if rep_id not in self.rep_ids():
            raise KeyError(rep_id)
        found = {n: self.read(n).where(F.col("rep_id") == rep_id).drop("rep_id") for n in PARTS}
        if self.faults(rep_id):
            raise ValueError(f"replication {rep_id} is damaged: {self.faults(rep_id)}")
        return found

    def faults(self, rep_id: int) -> list[str]:
        """What is wrong with a stored replication."""
        d, b, c = (self.read(n).where(F.col("rep_id") == rep_id) for n in PARTS)
        out = []
        if d.join(b, "bundle_row_id", "left_anti").limit(1).count():
            out.append("duals without a bundle")
        if c.groupBy("coord").count().where("count > 1").limit(1).count():
            out.append("repeated coordinates")
        if b.select(F.size("bundle")).distinct().count() > 1:
            out.append("bundles of several sizes")
        return out


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Same rows to the bit: doubles are compared as bytes, so zeros of different sign differ."""

    def raw(df: DataFrame) -> DataFrame:
        return df.select(*[F.hex(F.to_binary(F.col(f"`{f.name}`").cast("string"), F.lit("utf-8"))).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema])

    if a.schema.simpleString() != b.schema.simpleString():
        return False
    a, b = raw(a), raw(b)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

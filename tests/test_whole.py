"""Queries and operators over whole tables: nothing filtered, folded or capped away."""

import random

from pyspark.sql import functions as F

from choicefold import queries as q
from choicefold.operators import cuts

from .conftest import SF


def test_canonical_order_of_the_whole_log(spark):
    rows = [(i % 3, (i * 7919) % 5000, f"k{i % 4}".encode(), i) for i in range(2000)]
    log = spark.createDataFrame(rows, "rep_id int, agent_id bigint, bundle_key binary, pos bigint").repartition(5)
    got = sorted((r["n"], r["rep_id"], r["agent_id"], bytes(r["bundle_key"]), r["pos"]) for r in cuts.canonical_positions(log).collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows), 1)]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    whole = q.QUERIES["canonical_cut_order_whole"](spark, SF)
    assert whole.agg(F.max("n")).first()[0] == whole.count() == lines.count()


def test_cuts_of_different_agents_are_no_copies(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    assert q.QUERIES["dedup_cuts_whole"](spark, SF).count() == lines.count()


def test_reciprocal_edges_of_the_real_ids(spark):
    edges = {(r[0], r[1]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()}
    got = [(r["a"], r["b"]) for r in q.QUERIES["reciprocal_edges_whole"](spark, SF).collect()]
    assert sorted(got) == sorted((a, b) for a, b in edges if (b, a) in edges) and 0 < len(got) < 100

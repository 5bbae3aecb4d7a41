"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors get one more component, the square root of the greatest squared norm less their own, so that the largest inner product
with a query is the smallest distance (the query's own component is 0).  Trees are fitted on a bounded sample: each node's
hyperplane lies between two random points of it, through their middle or the median when that splits unevenly.  Every vector is then put into one leaf of each
tree.  A query walks all trees with one shared priority queue, ordered by how little it would have to cross a
hyperplane, until the leaves it reached hold enough candidates (a number and a share of the trees); those are reranked exactly, in double precision, on the original vectors.

Equal vectors are one class with its ``k + 1`` smallest ids, which is all that a list of k can use, so a very
common vector costs as much as any other.  Leaves are dealt in blocks of about ``BLOCK`` members.

Vectors that are null, zero or of another length than most, or hold null or non-finite components, take no part.
Repeated rows count once.  Fewer than k candidates: all of them.  An empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, stored

#: Vectors that the trees are fitted on, at most.
SAMPLE = 40_000
TREES = 2
#: Members of a leaf, at least, and leaves of a tree, at most.
LEAF, LEAVES = 64, 32
#: Candidates that a query looks at: at least these, and this share of every tree.
#: Vectors without near neighbours need so many: in 64 dimensions with a 20th best inner product of 0.41 of unit vectors, recall 0.9 takes two thirds of a table.
SEARCH, SHARE = 3000, 0.55
BLOCK = 4096
SEED = 3


@dataclass
class Tree:
    normal: np.ndarray  # nodes x dimensions
    offset: np.ndarray
    left: np.ndarray  # children; a negative one is leaf -x-1
    right: np.ndarray
    leaves: int


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of ``x`` with at most ``depth`` levels."""
    normal, offset, left, right, leaves = [], [], [], [], [0]

    def build(own: np.ndarray, level: int) -> int:
        if level >= depth or len(own) < 4:
            leaves[0] += 1
            return -leaves[0]
        for _ in range(8):
            a, b = x[rng.choice(own, 2, replace=False)]
            w = a - b
            if (norm := np.linalg.norm(w)) > 1e-12:
                break
        else:
            leaves[0] += 1
            return -leaves[0]
        w = w / norm
        z = x[own] @ w
        cut = float(w @ (a + b) / 2)
        if not 0.3 < (z > cut).mean() < 0.7:
            cut = float(np.median(z))
        up = z > cut
        if up.all() or not up.any():
            leaves[0] += 1
            return -leaves[0]
        i = len(normal)
        normal.append(w), offset.append(cut), left.append(0), right.append(0)
        left[i] = build(own[~up], level + 1)
        right[i] = build(own[up], level + 1)
        return i

    root = build(np.arange(len(x)), 0)
    if root < 0:
        return Tree(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0, int), np.zeros(0, int), 1)
    return Tree(np.array(normal), np.array(offset), np.array(left), np.array(right), leaves[0])


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row."""
    if not len(tree.normal):
        return np.zeros(len(x), np.int64)
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        n = at[open_]
        up = np.einsum("ij,ij->i", x[open_], tree.normal[n]) > tree.offset[n]
        at[open_] = np.where(up, tree.right[n], tree.left[n])
        open_ = open_[at[open_] >= 0]
    return -at - 1


def visits(trees: list[Tree], first: np.ndarray, size: np.ndarray, q: np.ndarray, search: int) -> list[int]:
    """Leaves (numbered over all trees from ``first``) that a query reaches through one queue, until they hold ``search`` members."""
    margins = [t.normal @ q - t.offset for t in trees]
    heap = [(-np.inf, i, 0 if len(t.normal) else -1) for i, t in enumerate(trees)]
    heapq.heapify(heap)
    found, total = [], 0
    while heap and total < search:
        far, i, node = heapq.heappop(heap)
        while node >= 0:
            m = margins[i][node]
            near, other = (trees[i].right[node], trees[i].left[node]) if m > 0 else (trees[i].left[node], trees[i].right[node])
            heapq.heappush(heap, (max(far, abs(m)), i, int(other)))
            node = int(near)
        leaf = int(first[i]) - node - 1
        if size[leaf]:
            found.append(leaf)
            total += int(size[leaf])
    return found


def _matrix(batch: pa.RecordBatch | pa.Table, name: str, dim: int) -> np.ndarray:
    c = batch.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, candidates: int = SEARCH, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of each query. ``vectors``: vec_id, embedding; ``is_query`` is over vec_id."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    dim = lengths["n"]
    v = v.where(F.size("embedding") == dim)
    # The k + 1 smallest ids of each distinct vector: the limit by rank works before the shuffle too.
    few = v.withColumn("r", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asked = v.where(is_query).select("embedding").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked, "embedding", "left")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    classes = stored(classes.select(F.get("ids", 0).alias("cls"), "embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), norm.alias("norm")), "ann-classes")
    n, top = classes.agg(F.count(F.lit(1)), F.max("norm")).first()
    depth = max(0, int(np.ceil(np.log2(max(1, min(LEAVES, n / LEAF))))))
    goal = max(candidates, int(share * n * trees))
    sampled = F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n))
    some = classes.where(sampled).select("cls", "embedding", "norm").orderBy("cls").limit(2 * SAMPLE).collect()
    sample = np.array([r["embedding"] for r in some], float).reshape(-1, dim)
    sample = np.column_stack([sample, np.sqrt(np.maximum(0, top - np.array([r["norm"] for r in some])))])
    rng = np.random.default_rng(SEED)
    forest = [grow(sample, depth, rng) for _ in range(trees)]
    first = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])
    shared = spark.sparkContext.broadcast(forest)  # at most TREES x 2 SAMPLE / 3 nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "embedding", dim)
            x = np.column_stack([x, np.sqrt(np.maximum(0, top - b.column("norm").to_numpy()))])
            leaf = np.stack([first[i] + leaf_of(t, x) for i, t in enumerate(shared.value)], 1).ravel()
            take = pa.array(np.repeat(np.arange(len(x)), len(shared.value)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *[b.column(c).take(take) for c in ("cls", "embedding", "ids")]], ["leaf", "cls", "embedding", "ids"])

    members = stored(classes.select("cls", "embedding", "ids", "norm").mapInArrow(place, "leaf long, cls long, embedding array<double>, ids array<long>"), "ann-members")
    size = np.zeros(first[-1], np.int64)
    for r in members.groupBy("leaf").count().collect():  # a row per leaf, as many as the forest has
        size[r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-size // BLOCK))
    sizes = spark.sparkContext.broadcast(size)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "embedding", dim)
            x = np.column_stack([x, np.zeros(len(x))])
            hit = [visits(shared.value, first, sizes.value, q, goal) for q in x]
            rows = [(i, leaf, s) for i, h in enumerate(hit) for leaf in h for s in range(int(-(-sizes.value[leaf] // BLOCK)))]
            i, leaf, s = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(s), b.column("cls").take(take), b.column("embedding").take(take)], ["leaf", "block", "cls", "embedding"])

    routed = classes.where("asked").select("cls", "embedding").mapInArrow(route, "leaf long, block long, cls long, embedding array<double>")
    table = F.map_from_arrays(*[F.array(*[F.lit(int(x)) for x in c]) for c in (np.flatnonzero(blocks > 1), blocks[blocks > 1])]) if (blocks > 1).any() else None
    count = F.lit(1) if table is None else F.coalesce(F.element_at(table, F.col("leaf").cast("int")), F.lit(1))
    dealt = members.withColumn("block", F.pmod(F.xxhash64("cls"), count.cast("long")))

    def rerank(key: tuple, own: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["cls", "found"]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("cls", pa.int64()), ("ids", pa.list_(pa.int64()))]))
        if not own.num_rows or not asking.num_rows:
            return pa.table({"cls": pa.array([], pa.int64()), "found": pa.array([], kind)})
        x, q = _matrix(own, "embedding", dim), _matrix(asking, "embedding", dim)
        ids, cls = own.column("ids").combine_chunks(), own.column("cls").to_numpy()
        order = np.argsort(cls)
        x, cls, ids = x[order], cls[order], ids.take(pa.array(order))
        keep, made = min(k + 1, len(x)), []
        near = min(keep + 16, len(x))
        for start in range(0, len(q), 512):
            part = q[start : start + 512]
            rough = part @ x.T
            picked = np.argpartition(-rough, near - 1, axis=1)[:, :near] if near < len(x) else np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
            for p, at in zip(part, picked, strict=True):
                at = np.sort(at)
                s = (x[at] * p).sum(1)  # the same sum for equal rows, wherever they lie
                best = np.argsort(-s, kind="stable")[:keep]
                made.append((at[best], s[best]))
        flat = np.concatenate([a for a, _ in made])
        parts = pa.StructArray.from_arrays([pa.array(np.concatenate([s for _, s in made])), pa.array(cls[flat]), ids.take(pa.array(flat))], names=["score", "cls", "ids"])
        lists = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * keep, parts)
        return pa.Table.from_arrays([asking.column("cls"), lists], names=names)

    found = dealt.groupBy("leaf", "block").cogroup(routed.groupBy("leaf", "block")).applyInArrow(rerank, "cls long, found array<struct<score:double,cls:long,ids:array<long>>>")
    # At most k + 1 classes of each block that a query reached; a class found in several trees is the same row.
    best = found.groupBy("cls").agg(F.flatten(F.collect_list("found")).alias("f"))
    ordered = F.array_sort(F.array_distinct(F.transform("f", lambda c: F.struct((-c["score"]).alias("s"), c["cls"].alias("cls"), c["ids"].alias("ids")))))
    best = best.select(F.col("cls"), F.slice(ordered, 1, k + 1).alias("f"))
    ids = F.flatten(F.transform("f", lambda c: F.transform(c["ids"], lambda i: F.struct(c["s"].alias("s"), i.alias("id")))))
    best = best.select("cls", F.array_sort(ids).alias("near")).join(classes.where("asked").select("cls", "embedding"), "cls").select("embedding", "near")
    queries = v.where(is_query).select("embedding", F.col("vec_id").alias("query_id")).join(best, "embedding")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    rows = queries.select("query_id", F.posexplode(own).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
    return rows

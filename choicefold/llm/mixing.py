"""Mixing of sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share
the words of all documents by weight, no source above ``CAP`` times its own words.  The
excess goes to the others by weight, which comes to one water level: each target is the
lesser of its cap and weight times level.

Sampling: a source whose target is r times its words takes floor(r) copies of each
document for certain.  The rest, a share p of its words, is sampled without replacement and with unequal odds: document i gets a
uniform number u (of its id, so reruns agree) and the rank [u/(1-u)] / [o p/(1-p)], the ratio of random odds to
inclusion odds, where o is the square root of its size over its source's mean, unless the caller gives other ``odds``.  The least ranks
are taken while they fit the target, and then each later one, in order of rank, that still fits, until none does.  What
then is missing is less than any document left; one more copy is taken of the largest document that fits and
has fewer than ``CAP`` copies.  A source never takes more than its target.

A source's cut-off is found from sums over rank buckets and then from the rows of one
bucket, so no task holds a whole source.  What is then missing is filled in rounds: the next FILL
documents that fit, one by one, then the cut-off again over the later ones that are no larger than what is still
missing.

Documents with one id are taken or left together; ties of rank go by id, ties of the last copy to the smaller id.  Null text has
size 0; texts without words are never taken for the sampled share.  Null sources are one source, the last.  Very long texts are read
once, to count their words.  An empty table gives no rows.  Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, maybe_broadcast, stored

CAP = 3
CYCLE = 3
#: Rank buckets of a source.
BUCKETS = 4096
#: Documents after a cut-off that a round looks at one by one; rounds go on until no document fits.
FILL = 64
SEED = "mix-1"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) of the id: 52 bits of an MD5 sum."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (``s``, null kept by ``s_null``): ``docs``, ``source_size`` and ``target``. ``sizes`` has s, s_null, size."""
    per = sizes.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Windows over one row per source.
    order = W.orderBy("s_null", "s")
    per = per.withColumn("w", ((F.row_number().over(order) - 1) % CYCLE + 1).cast("long")).withColumn("cap", F.col("source_size") * CAP)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "s_null", "s")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # Sources in order of cap by weight: the first whose cap isn't met sets the level for all after it.
    per = per.withColumn("left", left).withColumn("weight", weight)
    per = per.withColumn("open", F.col("cap") * F.col("weight") > F.col("left") * F.col("w"))
    level = F.max(F.when(F.col("open"), F.struct(-F.col("cap") / F.col("w"), (F.col("left") / F.col("weight")).alias("level")))).over(whole)["level"]
    open_from = F.min(F.when(F.col("open"), F.col("cap") / F.col("w"))).over(whole)
    capped = open_from.isNull() | (F.col("cap") / F.col("w") < open_from)
    return per.select("s_null", "s", "docs", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def _key(r: str, doc_id: str) -> Column:
    """Order of documents in a source: rank, then id; null ids first."""
    return F.struct(F.col(r).alias("r"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("id"))


def _taken(bucket: Column, key: Column) -> Column:
    """Whether a document comes before its source's cut-off."""
    at_edge = (bucket == F.col("_mx_edge")) & F.coalesce(key <= F.col("_mx_last"), F.lit(False))
    return F.when(F.col("_mx_edge").isNull(), F.col("_mx_need") > 0).otherwise((bucket < F.col("_mx_edge")) | at_edge)


def _cut_off(ranked: DataFrame, goal: DataFrame, n_sources: int, into: Scratch) -> DataFrame:
    """``goal`` with the cut-off of each source: ``edge`` bucket, ``last`` key in it and the ``gap`` that is left of ``need``.

    Documents below the edge bucket are taken, those of it up to the last one; a source without an edge takes all.
    """
    sums = ranked.groupBy("s_null", "s", "b").agg(F.sum("size").alias("n"), F.first("need").alias("need"))
    run = W.partitionBy("s_null", "s").orderBy("b")
    sums = sums.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    edge = sums.where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto"))).select("s_null", "s", "b", "before")
    edge = into.kept(edge)
    inside = ranked.join(maybe_broadcast(edge, n_sources), ["s_null", "s", "b"]).groupBy("s_null", "s", "r", "id").agg(F.sum("size").alias("n"), F.first("before").alias("before"), F.first("need").alias("need"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("s_null", "s").orderBy("r", F.col("id").asc_nulls_first()))
    inside = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("need"))
    last = inside.groupBy("s_null", "s").agg(F.max(_key("r", "id")).alias("last"), F.max("upto").alias("used"))
    cut = goal.join(edge.withColumnRenamed("b", "edge"), ["s_null", "s"], "left").join(last, ["s_null", "s"], "left")
    cut = cut.withColumn("gap", F.when(F.col("edge").isNull(), 0.0).otherwise(F.col("need") - F.coalesce("used", "before")))
    return cut.select(*[F.col(c).alias(f"_mx_{'sn' if c == 's_null' else c}") for c in cut.columns if c not in ("before", "used")])


def _filled(ranked: DataFrame, cut: DataFrame, n_sources: int, into: Scratch) -> DataFrame:
    """Documents after the cut-off (``_mx_sn``, ``_mx_s``, ``_mx_k``) that fill its gap: in order of rank, each that still fits."""
    me = _key("r", "id")
    fill = F.expr("""aggregate(next, named_struct('gap', gap, 'a', cast(array() as array<struct<r:double,id:bigint>>)),
        (acc, x) -> if(x.size <= acc.gap, named_struct('gap', acc.gap - x.size, 'a', array_append(acc.a, x.k)), acc))""")

    def of(rows: DataFrame, per: DataFrame) -> DataFrame:
        return rows.join(maybe_broadcast(per, n_sources), (F.col("s_null") == F.col("_mx_sn")) & (F.col("s") == F.col("_mx_s")))

    rest = of(ranked, cut).where((F.col("_mx_gap") > 0) & (F.col("size") > 0) & ~_taken(F.col("b"), me))
    rest = rest.groupBy("s_null", "s", "b", "r", "id").agg(F.sum("size").alias("size"), F.first("_mx_gap").alias("need")).where("size <= need")
    found = []
    while True:
        # One by one: of the next FILL those that fit.
        rest = into.kept(rest)
        head = rest.select("s_null", "s", "need", me.alias("k"), "size").withColumn("nth", F.row_number().over(W.partitionBy("s_null", "s").orderBy("k"))).where(F.col("nth") <= FILL)
        head = head.groupBy(F.col("s_null").alias("_mx_sn"), F.col("s").alias("_mx_s")).agg(F.first("need").alias("gap"), F.array_sort(F.collect_list(F.struct("k", "size"))).alias("next"), F.max("k").alias("_mx_seen"))
        head = into.kept(head.select("_mx_sn", "_mx_s", "_mx_seen", fill.alias("_mx_fill")))
        found.append(head.select("_mx_sn", "_mx_s", F.explode("_mx_fill.a").alias("_mx_k")))
        pool = of(rest, head).where((me > F.col("_mx_seen")) & (F.col("size") <= F.col("_mx_fill.gap")))
        # Written, not kept: a plan that refers to all rounds before would double with each.
        pool = into.stored(pool.select("s_null", "s", "b", "r", "id", "size", F.col("_mx_fill.gap").alias("need")), "mix-pool")
        if pool.isEmpty():
            break
        # Many at once: the cut-off over those that may fit.
        part = into.stored(_cut_off(pool, pool.groupBy("s_null", "s").agg(F.first("need").alias("need")), n_sources, into), "mix-cut")
        placed = of(pool, part)
        found.append(placed.where(_taken(F.col("b"), me)).select("_mx_sn", "_mx_s", me.alias("_mx_k")))
        rest = placed.where(~_taken(F.col("b"), me) & (F.col("size") <= F.col("_mx_gap"))).select("s_null", "s", "b", "r", "id", "size", F.col("_mx_gap").alias("need"))
    return reduce(DataFrame.unionAll, found).distinct()


def _last(sizes: DataFrame, cut: DataFrame, filled: DataFrame, n_sources: int, n_filled: int) -> DataFrame:
    """At most one document of each source (``_mx_sn``, ``_mx_s``, ``_mx_last_id``) of which one more copy fits the source's target: the largest, ties to the smaller id."""
    d = sizes.join(maybe_broadcast(cut, n_sources), (F.col("s_null") == F.col("_mx_sn")) & (F.col("s") == F.col("_mx_s"))).withColumn("_mx_k", _key("r", "id"))
    d = d.join(maybe_broadcast(filled.withColumn("fill", F.lit(True)), n_filled), ["_mx_sn", "_mx_s", "_mx_k"], "left")
    extra = (_taken(F.col("b"), F.col("_mx_k")) | F.col("fill").isNotNull()) & (F.col("size") > 0)
    d = d.select("_mx_sn", "_mx_s", "_mx_target", F.col("_mx_k.id").alias("id"), "size", (F.col("_mx_whole") + extra.cast("int")).alias("copies"))
    short = d.groupBy("_mx_sn", "_mx_s").agg((F.first("_mx_target") - F.sum(F.col("size") * F.col("copies"))).alias("short"))
    some = d.where((F.col("copies") < CAP) & (F.col("size") > 0)).join(maybe_broadcast(short, n_sources), ["_mx_sn", "_mx_s"]).where("size <= short")
    some = some.groupBy("_mx_sn", "_mx_s", "id").agg(F.sum("size").alias("size"), F.first("short").alias("short")).where("size <= short")
    best = some.groupBy("_mx_sn", "_mx_s").agg(F.min(F.struct((-F.col("size")).alias("size"), "id")).alias("x"))
    return best.select("_mx_sn", "_mx_s", F.col("x.id").alias("_mx_last_id"))


def mix(docs: DataFrame, odds: Column | None = None, seed: str = SEED) -> DataFrame:
    """All documents with every column of theirs, and mix_size, mix_source_size, mix_target, mix_copies.

    ``odds``: a positive factor on inclusion odds, over the columns of ``docs``.  Columns of ``docs`` with one of these four names are replaced.
    """
    mine = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    cols = [c for c in docs.columns if c.lower() not in mine]
    d = _mixed(docs, cols, odds, seed)
    return d.select(*[F.col("_mx_row").getField(c).alias(c) for c in cols], *[F.col(f"_{n}").alias(n) for n in mine])


def _mixed(docs: DataFrame, cols: list[str], odds: Column | None, seed: str) -> DataFrame:
    """``_mx_row`` (the columns ``cols`` in a struct, so that no name of theirs can clash) and the four columns of :func:`mix`, named with a leading ``_``."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in cols])
    own = (odds if odds is not None else F.lit(None)).cast("double")
    d = docs.select(row.alias("_mx_row"), F.col("doc_id").alias("_mx_id"), F.col("source").isNull().alias("_mx_sn"), F.coalesce(F.col("source"), F.lit("")).alias("_mx_s"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("_mx_size"), own.alias("_mx_o"))

    def rank(u: Column, p: Column, o: Column, size: Column, docs_: Column, source_size: Column) -> Column:
        by_size = F.when(size > 0, F.sqrt(size.cast("double") * docs_.cast("double") / source_size.cast("double"))).otherwise(F.lit(1.0))
        q = (u / (1 - u)) / (p / (1 - p) * F.coalesce(o, by_size))
        return q / (1 + q)

    with Scratch(docs.sparkSession) as s:
        # Tables, not kept in memory: what is built on them has short plans.
        sizes = s.stored(d.select(F.col("_mx_sn").alias("s_null"), F.col("_mx_s").alias("s"), F.col("_mx_id").alias("id"), F.col("_mx_size").alias("size"), F.col("_mx_o").alias("o")), "mix-sizes")
        goal = s.stored(targets(sizes), "mix-goal")
        n_sources = goal.count()
        goal = goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        goal = goal.withColumn("whole", F.least(F.floor("ratio"), F.lit(CAP)).cast("long"))
        goal = goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        goal = goal.withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.when(F.col("source_size") > 0, F.col("need") / F.col("source_size")).otherwise(F.lit(0.5)))))
        ranked = sizes.join(maybe_broadcast(goal, n_sources), ["s_null", "s"]).withColumn("r", rank(uniform(F.col("id"), seed), F.col("p"), F.col("o"), F.col("size"), F.col("docs"), F.col("source_size")))
        ranked = ranked.withColumn("b", F.floor(F.col("r") * BUCKETS).cast("long")).select("s_null", "s", "id", "size", "r", "b", "need")
        cut = s.stored(_cut_off(ranked, goal, n_sources, s), "mix-cut")
        filled = stored(_filled(ranked, cut, n_sources, s), "mix-filled")
        n_filled = filled.count()
        last = s.stored(_last(ranked, cut, filled, n_sources, n_filled), "mix-last")
        # What the result reads: a row per source, and the few documents taken beyond the cut-offs.
        cut = stored(cut.join(maybe_broadcast(last, n_sources), ["_mx_sn", "_mx_s"], "left"), "mix-cut")
    d = d.join(maybe_broadcast(cut, n_sources), ["_mx_sn", "_mx_s"])
    d = d.withColumn("_mx_r", rank(uniform(F.col("_mx_id"), seed), F.col("_mx_p"), F.col("_mx_o"), F.col("_mx_size"), F.col("_mx_docs"), F.col("_mx_source_size")))
    d = d.withColumn("_mx_k", _key("_mx_r", "_mx_id"))
    extra = _taken(F.floor(F.col("_mx_r") * BUCKETS), F.col("_mx_k"))
    if n_filled:
        d = d.join(maybe_broadcast(filled.withColumn("_mx_fill", F.lit(True)), n_filled), ["_mx_sn", "_mx_s", "_mx_k"], "left")
        extra = extra | F.col("_mx_fill").isNotNull()
    more = F.coalesce(F.col("_mx_k.id") == F.col("_mx_last_id"), F.lit(False))
    copies = F.col("_mx_whole") + F.when(F.col("_mx_size") == 0, F.lit(0)).otherwise(extra.cast("int") + more.cast("int"))
    return d.select("_mx_row", F.col("_mx_size").alias("_mix_size"), F.col("_mx_source_size").alias("_mix_source_size"), F.col("_mx_target").alias("_mix_target"), F.least(copies, F.lit(CAP)).cast("long").alias("_mix_copies"))


def taken(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as many times as the mix takes it, with the columns of ``docs``."""
    m = _mixed(docs, docs.columns, None, SEED)
    m = m.withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int"))))
    return m.select(*[F.col("_mx_row").getField(c).alias(c) for c in docs.columns])

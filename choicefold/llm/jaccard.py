"""Jaccard join of word shingles through parity sketches.

Every shingle flips one bit of a document's sketch, so the Hamming distance of two sketches is at most the symmetric difference of
the sets.  The sketch is used at two widths.

* Wide, to find candidates: documents are joined within size bands.  Two sets as similar as asked differ in at most ``d``
  elements, where d follows from the band, so of the sketch's ``d + r`` blocks at least r are equal.  By that pigeonhole it is
  enough to index each document by ``d + 1`` of its blocks in an order that depends on a block's content alone: those with most
  bits set come first, so empty and nearly empty blocks, which unrelated documents share, are the ones left out.  A wide block is
  mostly empty and is kept as the XOR of the hashes of its set bits.
* Narrow, to drop candidates: the same bits folded to ``2 ** k`` of them, at least two for an element.  Candidates carry these few
  bytes, and only pairs whose Hamming distance doesn't exceed the difference their sizes allow have their sets compared.

Equal sets are one class from the start.  A block's documents are compared with its leader, the least document of it (of a very
common block, one of its documents, found on a sample); only where that leaves several components are the others compared with
each other, by sketches in blocks of bounded size and then, those that come near another component, by sets in
blocks that give back only links which join components.  So a group of near copies costs about as many checks as it has members, no
pairs within it become rows, and no link between components is lost.  Very common blocks and leaders are dealt over tasks.
Verification compares whole sets of 64-bit shingle hashes.

No words, null text: an empty set, linked with nothing.  Repeated rows: one class; rows that repeat an id with other texts are one
document with several sets.  Rows without an id: returned with no component.  An empty table: no rows.  Very long texts are taken
whole; a batch holds at least one text and about 2 MB.  Ties (sets at the threshold exactly) are links.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free_names, maybe_broadcast, runs, stored
from .components import components

#: Ratio of a size band.
BAND = 1.5
#: Document ids that may be broadcast (8 bytes each); beyond it the text is shuffled.
BROADCAST_IDS = 2_000_000
#: Documents of one leader that a task compares at a time with as many others.
STAR = 400
#: Documents whose blocks are counted to find the very common ones (a choice of plan, not of results), and from which count on a block is.
LOOK, COMMON = 20_000, 100
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of a multiply-xorshift kind."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``n`` words; of the whole sequence if it is shorter."""
    # The replacement comes first: it makes a new array, and ascii_lower() garbles slices of one.
    spaced = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\t\n\x0b\x0c\r]", " ")
    lists = pc.split_pattern(pc.ascii_lower(spaced), " ")
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    index, per = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    if "" in known:  # spaces in a row leave empty words
        full = index != known.index("")
        per = np.bincount(np.repeat(np.arange(len(per)), per)[full], minlength=len(per))
        index = index[full]
    with np.errstate(over="ignore"):
        h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, known), _U, len(known)), 0x5851F42D4C957F2D)[index]

        def joined(x: np.ndarray, k: int) -> np.ndarray:
            acc = np.zeros(max(0, len(x) - k + 1), _U)
            for i in range(k):
                acc = acc * _U(0x9E3779B97F4A7C15) + x[i : i + len(acc)]
            return _mix(acc, k)

        every, out = joined(h, n), []
        for start, k in zip((np.cumsum(per) - per).tolist(), per.tolist(), strict=True):
            out.append(np.unique(every[start : start + k - n + 1]) if k >= n else joined(h[start : start + k], k) if k else np.zeros(0, _U))
    return out


def most_apart(a: int, percent: int) -> int:
    """The greatest symmetric difference of a set of ``a`` elements and one as large or larger that is similar enough."""
    b = 100 * a // percent
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands of the smaller set of a pair: ``top(i)`` is the largest size of band i."""

    def __init__(self, percent: int):
        self.percent = percent

    def of(self, n: int) -> int:
        i = int(np.log(n) / np.log(BAND))
        while self.top(i) < n:
            i += 1
        while i and self.top(i - 1) >= n:
            i -= 1
        return i

    def top(self, i: int) -> int:
        return int(BAND ** (i + 1))

    def joined(self, n: int) -> list[tuple[int, int]]:
        """Bands in which a set of n elements is to be found, with their greatest difference."""
        least = -(-self.percent * n // 100)
        return [(i, d) for i in range(self.of(max(1, least)), self.of(n) + 1) if (d := most_apart(self.top(i), self.percent))]


def block_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the indexed blocks of a set in all its bands; none for an empty set."""
    out: list[np.ndarray] = []
    if not len(h):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        bits = _mix(h, 0x2545F4914F6CDD1D)
        for band, d in bands.joined(len(h)):
            k = d + 1 + max(6, d // 2)
            block = ((h >> _U(32)) * _U(k)) >> _U(32)  # h is sorted, and so are blocks
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            key, count = np.bitwise_xor.reduceat(bits, first), np.diff(np.append(first, len(h)))
            block = block[first]
            if len(block) > d + 1:
                best = np.lexsort((key, -count))[: d + 1]
                key, block = key[best], block[best]
            elif len(block) < d + 1:  # the rest are empty blocks, all of them
                empty = np.setdiff1d(np.arange(k, dtype=_U), block)[: max(0, k - len(block))]
                key, block = np.concatenate([key, np.zeros(len(empty), _U)]), np.concatenate([block, empty])
            out.append(_mix(key + _mix(block, band + 1), 0x9FB21C651E98DF25))
    return np.concatenate(out) if out else np.zeros(0, _U)


def sketch(h: np.ndarray) -> np.ndarray:
    """The narrow parity sketch of a set as 64-bit words: a power of two of them, two at least, and two bits or more for an element."""
    width = 1 << max(7, int(2 * len(h) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = (_mix(h, 0x6A09E667F3BCC909) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def hamming(x: str, y: str) -> str:
    """SQL: distance of the sketches in columns x and y; the wider one, of at most twice the width, is folded first."""
    fold = "zip_with(slice({0}, 1, shiftright(size({0}), 1)), slice({0}, shiftright(size({0}), 1) + 1, shiftright(size({0}), 1)), (p, q) -> p ^ q)"
    a, b = (f"if(size({u}) > size({v}), {fold.format(u)}, {u})" for u, v in ((x, y), (y, x)))
    return f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def may_differ(n: str, m: str, percent: int) -> str:
    """SQL: the greatest symmetric difference of sets of n and m elements that are similar enough."""
    return f"({100 - percent} * ({n} + {m}) div {100 + percent})"


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that name the set, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text", 2_000_000):
            sets = shingle_sets(batch.column("text"), n)
            with np.errstate(over="ignore"):
                hi, lo = ([int(_mix(s, seed).sum(dtype=_U).astype(np.int64)) for s in sets] for seed in (0x1234567, 0x89ABCDE))
            bits = [sketch(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            made = [batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(bits)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "hi", "lo", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, bits array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, np.concatenate([np.zeros(0, np.int64), *arrays]).view(np.int64))


def _keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in runs(batches, "text", 2_000_000):
            found = [block_keys(h, bands) for h in shingle_sets(batch.column("text"), n)]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column("doc_id").take(pa.array(of))], ["key", "doc"])

    return docs.mapInArrow(run, "key long, doc long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists([s.view(np.int64) for s in shingle_sets(batch.column("text"), n)])], ["doc", "hs"])

    return docs.mapInArrow(run, "doc long, hs array<long>")


def _some(docs: DataFrame, ids: DataFrame, into: Scratch) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (doc_id)."""
    ids = into.kept(ids.distinct())
    return docs.join(maybe_broadcast(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi")


def _to_leaders(rows: DataFrame, leaders: DataFrame, pairs: DataFrame, into: Scratch) -> DataFrame:
    """``rows`` (with a and b of ``pairs``) joined to ``leaders`` by ``a``; a leader of many rows is copied, once for about STAR of them."""
    many = into.kept(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("copies")).where("copies > 1"))
    many = maybe_broadcast(many, many.count())
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int")
    rows = rows.join(many, "a", "left").withColumn("part", part).drop("copies")
    leaders = leaders.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return rows.join(leaders, ["a", "part"]).drop("part")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int, into: Scratch) -> DataFrame:
    """Those ``pairs`` (a the leader, b) whose sketches are no further apart than similar sets may be."""
    mine = sketches.select(F.col("doc").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
    theirs = sketches.select(F.col("doc").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
    both = _to_leaders(pairs.join(mine, "b"), theirs, pairs, into)
    most = may_differ("n", "m", percent)
    return both.where(F.expr(f"case when abs(n - m) <= {most} then {hamming('x', 'y')} <= {most} else false end")).select(*pairs.columns).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, into: Scratch) -> DataFrame:
    """Those ``pairs`` (a the leader, b) whose sets are similar enough. A set is shuffled once for each pair it is the b of."""
    with Scratch(docs.sparkSession) as s:
        pairs = s.kept(pairs.select("a", "b").distinct())
        mine = _sets(_some(docs, pairs.select(F.col("b").alias("doc_id")), s), n).select(F.col("doc").alias("b"), F.col("hs").alias("y"))
        theirs = _sets(_some(docs, pairs.select(F.col("a").alias("doc_id")), s), n).select(F.col("doc").alias("a"), F.col("hs").alias("x"))
        both = _to_leaders(mine.join(maybe_broadcast(pairs, pairs.count(), BROADCAST_IDS), "b"), theirs, pairs, s)
        same = F.size(F.array_intersect("x", "y"))
        return into.stored(both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b").distinct(), "jaccard-links")


def _labels(pairs: DataFrame, label: DataFrame, *names: str) -> DataFrame:
    """``pairs`` with the component ``c_<name>`` of each named column, its own id if it has no link yet."""
    for name in names:
        pairs = pairs.join(label.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}")), name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))
    return pairs


def _dealt(star: DataFrame, into: Scratch) -> DataFrame:
    """The documents of each leader (a, b, ...) in blocks of about STAR, one copy for each pair (i, j) of blocks it is in."""
    size = into.kept(star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = star.join(maybe_broadcast(size, size.count()), "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.drop("blocks").withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})


def _astray(star: DataFrame, percent: int, into: Scratch) -> DataFrame:
    """Of the documents of each leader (a, b, c, size, bits) those whose sketch comes near one of another component."""

    def compare(t: pa.Table) -> pa.Table:
        doc, c, size = (t.column(x).to_numpy() for x in ("b", "c", "size"))
        bits = t.column("bits").combine_chunks()
        words, flat = pc.list_value_length(bits).to_numpy(), bits.flatten().to_numpy()
        ends = np.cumsum(words)
        hit = np.zeros(len(doc), bool)
        for w in np.unique(words).tolist():
            own, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
            x = flat[(ends[own] - w)[:, None] + np.arange(w)]
            wide = flat[(ends[twice] - 2 * w)[:, None] + np.arange(2 * w)]
            other, y = np.concatenate([own, twice]), np.concatenate([x, wide[:, :w] ^ wide[:, w:]])
            for start in range(0, len(own), max(1, 2_000_000 // (len(other) * w))):
                part = own[start : start + max(1, 2_000_000 // (len(other) * w))]
                apart = np.bitwise_count(x[start : start + len(part), None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                near = (apart <= (100 - percent) * (size[part][:, None] + size[other][None, :]) // (100 + percent)) & (c[part][:, None] != c[other][None, :])
                hit[part] |= near.any(1)
                hit[other] |= near.any(0)
        return t.select(["a", "b", "c"]).filter(pa.array(hit))

    return _dealt(star, into).groupBy("a", "i", "j").applyInArrow(compare, "a long, b long, c long").distinct()


def _across(star: DataFrame, sets: DataFrame, percent: int, into: Scratch) -> DataFrame:
    """Links (a, b) between documents of one leader (rows a, b, c) that join components: enough of them, not all.

    A task compares one block of documents with another (or itself) by products of
    0/1 matrices and gives back at most a forest. So no pair becomes a row, and no task holds more than two blocks.
    """

    def compare(t: pa.Table) -> pa.Table:
        doc, c = t.column("b").to_numpy(), t.column("c").to_numpy()
        hs = t.column("hs").combine_chunks()
        n = pc.list_value_length(hs).to_numpy()
        _, at, times = np.unique(hs.flatten().to_numpy(), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(doc)), n)
        both = times[at] > 1
        at, of = at[both], of[both]
        column = (np.cumsum(times > 1) - 1)[at]
        same = np.zeros((len(doc), len(doc)), np.float32)
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, (start, start + 4096))
            x = np.zeros((len(doc), 4096), np.float32)
            x[of[lo:hi], column[lo:hi] - start] = 1
            same += x @ x.T
        alike = (100 * same >= percent * (n[:, None] + n[None, :] - same)) & (c[:, None] != c[None, :])
        a, b = np.nonzero(np.triu(alike, 1))
        _, first = np.unique(np.stack([c[a], c[b]]), axis=1, return_index=True)  # one link for two components
        return pa.table({"a": pa.array(doc[a[first]]), "b": pa.array(doc[b[first]])})

    dealt = _dealt(star, into).join(sets.select(F.col("doc").alias("b"), "hs"), "b")
    return dealt.groupBy("a", "i", "j").applyInArrow(compare, "a long, b long")


def _led(reps: DataFrame, whole: int, n: int, percent: int, into: Scratch) -> DataFrame:
    """key, doc, lead for all blocks with more than one document.

    The window over a block streams its rows of two numbers through one task; very common blocks are found beforehand on a sample
    of documents, get their leader from it and are dealt by document.
    """
    some = reps.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, LOOK / whole))) if whole > LOOK else reps
    common = _keys(some, n, percent).groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("first")).where(F.col("m") >= COMMON).select("key", "first")
    common = into.kept(common)
    by_key = W.partitionBy("key", "part")
    keys = _keys(reps, n, percent).join(maybe_broadcast(common, common.count()), "key", "left")
    keys = keys.withColumn("part", F.when(F.col("first").isNotNull(), F.xxhash64("doc")))
    keys = keys.withColumn("m", F.count(F.lit(1)).over(by_key)).withColumn("least", F.min("doc").over(by_key))
    return keys.where((F.col("m") > 1) | F.col("first").isNotNull()).select("key", "doc", F.coalesce("first", "least").alias("lead"))


def groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as s:
        # Tables, not kept in memory, where much is built on them: plans stay short.
        rows = s.stored(_classes(docs, n), "jaccard-rows")
        full: Column = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        classes = s.stored(rows.where(full).groupBy("n_shingles", "hi", "lo").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
        # Documents that stand for a class: all but the others, which are the fewer.
        other = s.stored(rows.where(full).select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "jaccard-other")
        n_other = other.count()

        def standing(df: DataFrame) -> DataFrame:
            return df.join(maybe_broadcast(other, n_other, BROADCAST_IDS), "doc_id", "left_anti")

        reps = standing(docs.where(F.col("doc_id").isNotNull()))
        sketches = standing(rows.where(full)).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "bits")
        shared = s.stored(_led(reps, rows.count(), n, percent, s), "jaccard-shared")  # a table, so that the shuffle of all keys can go
        members = s.stored(shared.where("lead != doc").groupBy(F.col("lead").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("votes")), "jaccard-members")
        pairs = s.stored(_near(members, sketches, percent, s), "jaccard-pairs")
        # First each document against the one that leads most of its blocks.
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a"))
        links = _verified(best, docs, n, percent, s)
        label = components(links, s)
        # Then against its other leaders, where they are in another component.
        more = _verified(_labels(pairs.select("a", "b"), label, "a", "b").where("c_a != c_b"), docs, n, percent, s)
        if not more.isEmpty():
            links = links.union(more)
            label = components(links, s)
        # What is left are documents of one leader in several components.
        star = s.stored(_labels(members.select("a", "b"), label, "b").withColumnRenamed("c_b", "c"), "jaccard-star")
        torn = s.kept(star.groupBy("a").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("a"))
        star = star.join(maybe_broadcast(torn, torn.count(), BROADCAST_IDS), "a", "left_semi")
        lost = s.stored(_astray(star.join(sketches.withColumnRenamed("doc", "b"), "b"), percent, s), "jaccard-lost")
        if not lost.isEmpty():
            sets = _sets(_some(docs, lost.select(F.col("b").alias("doc_id")), s), n)
            across = s.stored(_across(lost, sets, percent, s), "jaccard-links")
            if not across.isEmpty():
                label = components(links.union(across), s)
        named = classes.join(label, F.col("rep") == F.col("id"), "left").select("n_shingles", "hi", "lo", F.coalesce("component", "rep").alias("component_id"))
        linked = rows.where(full).join(named, ["n_shingles", "hi", "lo"]).select("doc_id", "n_shingles", "component_id")
        lone = rows.where(~full | full.isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stored(linked.unionByName(lone), "jaccard-groups")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each group; rows without words or id stay, and so does every column."""
    name = free_names(docs, "gone")[0]
    gone = groups(docs, n, percent).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(maybe_broadcast(gone, gone.count(), BROADCAST_IDS), F.col("doc_id") == F.col(name), "left_anti")

"""URL filter: gradient-boosted trees on lexical features, beside a list of rules.

A rule names a host and the beginning of a path; it holds for the host and all its subdomains, and the
longest rule that holds decides.  URLs that a rule decides are the labelled ones; trees learn from
their lexical form (length, depth, share of digits, entropy, parameter counts, statistics of both its ends: the suffix of the host
and the first segment of the path) and decide the rest.  Statistics are taken over all URLs, by the exact suffix or segment, and joined back; they
are broadcast only up to a counted bound.  A labelled URL's own share of blocked ones comes from other folds than its own, and trees
see each example also as if its suffix, or its segment, had no labels, which is what most URLs they decide look like.  Trees are fitted on the
driver on at most ``TRAIN_ROWS`` labelled URLs, a sample by hash when there are more.

Null URL or none with ``://``: host and path are empty, no rule holds and the trees decide.  Repeated rows (and rows without an id): a
row each.  Very long URLs are read whole.  Ties: of rules of one length the later in the list wins; a score of 0.5 blocks.  Without both kinds of
labels every other URL is allowed.  An empty table: no rows.  Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch, maybe_broadcast, stored

TRAIN_ROWS = 50_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.2, 32, 5
SEED = 5
FEATURES = ("url", "host", "path", "common", "share", "seg_common", "seg_share")
FOLDS, PRIOR = 5, 10


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty for null or no ``://``."""
    u = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name of the longest rule that holds (null: none), and whether it blocks."""
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the last that holds wins
        holds = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, block = F.when(holds, r.name).otherwise(name), F.when(holds, F.lit(r.block)).otherwise(block)
    return name, block


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment(path: Column) -> Column:
    """The first segment of a path."""
    return F.regexp_extract(path, r"^/([^/]*)", 1)


def lexical(url: str, host: str, path: str) -> list[float]:
    """Lexical features of one URL; those of its suffix are added by the caller."""
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    counts = np.unique(np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1] / max(1, len(url.encode("utf-8", "surrogatepass")))
    words = re.split(r"[^A-Za-z0-9]+", host)
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), host.count("-"), float(-(counts * np.log2(counts)).sum()) if url else 0.0,
        len([p for p in query.split("&") if p]), float("#" in url), float(url.startswith("https")), max(map(len, words)), len(path.rsplit("/", 1)[-1]), float("." in path), sum(not c.isalnum() for c in url) / n,
    ]


class Trees:
    """Logistic boosting over binned features: each tree a list of (feature, threshold) per level and node, values at its leaves."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # Thresholds lie between values, so that rounding of a value never changes its side.
        seen = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1), method="nearest")) for c in x.T]
        edges = [(c[:-1] + c[1:]) / 2 for c in seen]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = math.log(share / (1 - share))
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for depth in range(DEPTH):
                level, below = [], np.zeros(len(y), int)
                for k in range(1 << depth):
                    own = np.flatnonzero(node == k)
                    best = (1e-6, -1, 0.0, 0)
                    for f, e in enumerate(edges):
                        if len(e) and len(own) >= 2 * LEAST:
                            b = binned[own, f]
                            sg, sh, sn = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                            tg, th = g[own].sum(), h[own].sum()
                            gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                            gain[(sn < LEAST) | (len(own) - sn < LEAST)] = 0
                            if gain[i := int(gain.argmax())] > best[0]:
                                best = (float(gain[i]), f, float(e[i]), i)
                    level.append((best[1], best[2]))
                    below[own] = 2 * k + ((binned[own, best[1]] > best[3]) if best[1] >= 0 else 0)
                node = below
                splits.append(level)
            leaves = np.array([RATE * g[node == k].sum() / (h[node == k].sum() + 1) for k in range(1 << DEPTH)])
            self.trees.append((splits, leaves))
            z = z + leaves[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        z = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), int)
            for level in splits:
                f, t = np.array([a for a, _ in level])[node], np.array([b for _, b in level])[node]
                node = 2 * node + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > t))
            z += leaves[node]
        return 1 / (1 + np.exp(-z))


def _with_share(p: DataFrame, by: str, rate: float, common: str, share: str, into: Scratch) -> DataFrame:
    """How common a row's value of ``by`` is, and the share of labelled URLs of that value that are blocked, without the row's own fold."""
    hit = F.col("label").cast("int")
    per_fold = [a for f in range(FOLDS) for a in (F.count_if(F.col("label").isNotNull() & (F.col("fold") == f)).alias(f"k{f}"), F.coalesce(F.sum(F.when(F.col("fold") == f, hit)), F.lit(0)).alias(f"s{f}"))]
    stats = into.kept(p.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *per_fold))
    k, s = (F.array(*[F.col(f"{x}{f}") for f in range(FOLDS)]) for x in ("k", "s"))
    stats = stats.select(by, F.log1p("n").alias(common), k.alias("ks"), s.alias("ss"))
    p = p.join(maybe_broadcast(stats, stats.count()), by)

    def others(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - F.when(F.col("label").isNotNull(), F.get(c, F.col("fold"))).otherwise(F.lit(0))

    return p.withColumn(share, (others("ss") + PRIOR * rate) / (others("ks") + PRIOR)).drop("ks", "ss")


def judge(pages: DataFrame, rules: list[Rule], learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score for every row of ``pages`` (page_id, url). ``learn``: rows whose labels may be learned from (all)."""
    with Scratch(pages.sparkSession) as scratch:
        return stored(_judged(pages, rules, F.lit(True) if learn is None else learn, scratch), "url-verdicts")


def _judged(pages: DataFrame, rules: list[Rule], learn: Column, scratch: Scratch) -> DataFrame:
    host, path = parts(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"), learn.alias("learn"))
    name, block = ruled(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", name).withColumn("block", block).withColumn("label", F.when(F.col("learn"), F.col("block"))).withColumn("suffix", suffix(F.col("host"))).withColumn("segment", segment(F.col("path")))
    p = p.withColumn("fold", F.pmod(F.xxhash64("url", "page_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))
    whole = p.agg(F.count("label").alias("k"), F.sum(F.col("label").cast("int")).alias("s")).first()
    known = whole["k"] or 0
    rate = (whole["s"] or 0) / max(1, known)
    p = _with_share(p, "suffix", rate, "common", "share", scratch)
    p = _with_share(p, "segment", rate, "seg_common", "seg_share", scratch)

    def features(urls: list, hosts: list, paths: list, *ends: list) -> np.ndarray:
        return np.column_stack([np.array([lexical(*x) for x in zip(urls, hosts, paths, strict=True)], float), *ends])

    trees = None
    if 0 < rate < 1:
        some = p.where("label is not null")
        if known > TRAIN_ROWS:
            some = some.where(F.pmod(F.xxhash64("url", "page_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * TRAIN_ROWS / known))
        rows = some.select(*FEATURES, "label").orderBy("url").collect()
        if rows and len({r["label"] for r in rows}) == 2:
            x, y = features(*([r[c] for r in rows] for c in FEATURES)), np.array([r["label"] for r in rows], float)
            unlabelled = [x.copy(), x.copy()]
            mix = np.random.default_rng(SEED)
            for part, end in zip(unlabelled, (-4, -2), strict=True):  # suffix, segment: how common it is tells nothing here, the share is the prior
                part[:, end], part[:, end + 1] = mix.permutation(x[:, end]), rate
            trees = Trees().fit(np.concatenate([x, *unlabelled]), np.tile(y, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = trees.predict(features(*(batch.column(c).to_pylist() for c in FEATURES))) if trees and n else np.zeros(n)
            said = [("block" if (s >= 0.5 if b is None else b) else "allow") for s, b in zip(score.tolist(), batch.column("block").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(said, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return p.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_score double")

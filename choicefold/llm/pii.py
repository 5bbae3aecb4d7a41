"""Personal data by weak supervision, in DataFrame functions only.

Base spans follow fixed patterns and always stay.  The method adds spans: wider patterns propose
candidates (keys and tokens; telephone numbers without a plus), four labelers vote on each (shape,
gazetteer of words before it, context of signs before it, variety of its characters),
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and
a logistic span classifier is trained on its posteriors, with length and share of digits as
further features.  Counts are taken over all documents; the driver sees only one row per pattern
of features, at most a few hundred.

Positions: a text is cut by its matches, so lengths of the parts give them, in code
points, summed in n log n steps for n matches, so that very long texts with very many matches stay cheap.  Null or empty text: no
spans.  Repeated rows: a row each, and rows without an id too.  An empty table: no rows.  No candidates at all: nothing is added.  Ties: of spans that begin
together, :func:`redact` names the one that ends first, then the kind listed first.  Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

KINDS = ("email", "ip", "card", "phone", "secret")
# The contract's patterns, made linear: a match can begin only where a run of its first characters
# begins or where the last match ended, and repeats never give back what they took.
_L = "A-Za-z0-9._%+-"
_P = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick test without which a kind can't occur.
GUARD = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_S = "A-Za-z0-9_/+=-"
CANDIDATE = {
    "secret": rf"(?<![{_S}])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[{_S}]{{16,}}+",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
SHAPE = {"secret": r"^[0-9a-f]{32,}$|^(AKIA|ASIA|ghp_|gho_|sk-|pk-|xox)[A-Za-z0-9_-]{8,}|^[A-Za-z0-9+/]{40,}={0,2}$", "phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"}
GAZETTEER = {"secret": r"\b(token|secret|key|apikey|password|passwd|pwd|bearer|auth|credential)s?\b", "phone": r"\b(phone|tel|telephone|telefon|telefono|call|mobile|cell|fax|handy)\b"}
CONTEXT = {"secret": r"[=:][\x20]*[\"'`]?$", "phone": r"([:(]|\bat|\bon)[\x20]*$"}
#: Characters before a span that the labelers see.
BEFORE = 40
N_VOTES = 4


def _places(text: str, kind: str, regex: str) -> tuple[Column, Column]:
    guard = GUARD.get(kind)
    quick = F.col(text).rlike("[0-9]") if guard is None else F.contains(F.col(text), F.lit(guard))
    none = F.array().cast("array<string>")
    return F.when(quick, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none), F.when(quick, F.split(text, regex, -1)).otherwise(none)


def _running(a: Column, merge: Callable[[Column, Column], Column], none: int) -> Column:
    """Element i of an int array merged with all before it, by steps of 1, 2, 4, ...: n log n, where appending to an array is quadratic."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, a, lambda acc, step: F.transform(acc, lambda x, i: merge(x, F.coalesce(F.get(acc, i - step), F.lit(none)))))


def _spans(m: str, p: str) -> Column:
    """Structs s, e (code points, end exclusive), m from matches and the parts between them."""
    ends = _running(F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda x, y: F.length(x) + F.length(y)), lambda x, y: x + y, 0)
    return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m")))


def _apart(cands: Column, base: Column) -> Column:
    """Those of ``cands`` (s, e, m) that overlap none of ``base`` (s, e): one sorted list, the furthest end before and the nearest start after."""
    every = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("c"), x["e"].alias("e"), F.lit("").alias("m"))),
        F.transform(cands, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("c"), x["e"].alias("e"), x["m"].alias("m"))),
    ))
    far = 2**31 - 1
    before = _running(F.transform(every, lambda x: F.when(x["c"] == 0, x["e"]).otherwise(0)), F.greatest, 0)
    after = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(x["c"] == 0, x["s"]).otherwise(far))), F.least, far))
    clear = F.zip_with(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), every, lambda n, x: F.when((x["c"] == 1) & (n["b"] <= x["s"]) & (n["a"] >= x["e"]), x))
    found = F.transform(F.filter(clear, lambda x: x.isNotNull()), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.when((F.size(cands) == 0) | (F.size(base) == 0), cands).otherwise(found)


def _luhn(digits: Column) -> Column:
    """Digits from the right: each second one doubled, less 9 if above 9; the sum must end in 0."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(F.substr(back, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_P}\.{_P}\.{_P}\.{_P}$")
    digits = F.translate(m, "-+(). ", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_base`` (kind, s, e) and ``pii_cands`` (kind, s, e, votes, features) of every whole text; columns of ``docs`` with these names are replaced."""
    cols = [c for c in docs.columns if c.lower() not in ("pii_base", "pii_cands")]
    # Other columns ride in one struct, so that no name of theirs can clash.
    d = docs.select(F.struct(*[_named(c) for c in cols]).alias("pii_row"), F.coalesce("text", F.lit("")).alias("pii_text"))
    every = {**{f"b_{k}": (k, r) for k, r in BASE.items()}, **{f"c_{k}": (f"c_{k}", r) for k, r in CANDIDATE.items()}}
    for name, (k, regex) in every.items():
        m, p = _places("pii_text", k, regex)
        d = d.withColumn(f"pii_{name}_m", m).withColumn(f"pii_{name}_p", p)
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    for name in every:
        d = d.withColumn(f"pii_{name}", F.when(F.size(f"pii_{name}_m") > 0, _spans(f"pii_{name}_m", f"pii_{name}_p")).otherwise(none))

    def base(k: str) -> Column:
        held = F.filter(f"pii_b_{k}", lambda x: _valid(k, x["m"]))
        return F.transform(held, lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    d = d.withColumn("pii_base", F.concat(*[base(k) for k in BASE]))

    def candidate(k: str) -> Column:
        # A number that is part of a base span is no other one; a key may well hold digits that look like a card.
        apart = F.col(f"pii_c_{k}") if k == "secret" else _apart(F.col(f"pii_c_{k}"), F.col("pii_base"))

        def judged(x: Column) -> Column:
            before = F.substr(F.col("pii_text"), F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
            n, n_digits = F.length(x["m"]), F.length(F.regexp_replace(x["m"], "[^0-9]+", ""))
            share = F.floor(n_digits * 4 / n).cast("int")
            kinds = F.size(F.array_distinct(F.split(x["m"], "")))
            votes = (x["m"].rlike(SHAPE[k]), F.lower(before).rlike(GAZETTEER[k]), before.rlike(CONTEXT[k]), (kinds >= 9) if k == "secret" else (kinds >= 6))
            return F.struct(
                F.lit(KINDS.index(k)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[v.cast("int").alias(f"v{i}") for i, v in enumerate(votes)],
                F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(8)).alias("size"), F.least(share, F.lit(3)).alias("digits"),
            )

        return F.transform(apart, judged)

    return d.withColumn("pii_cands", F.concat(*[candidate(k) for k in CANDIDATE])).select(*[F.col("pii_row").getField(c).alias(c) for c in cols], "pii_base", "pii_cands")


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by kind: bias, votes, size, digits."""

    weights: dict[int, tuple[float, ...]]
    reliability: dict[int, list[tuple[float, float]]]

    def accepts(self, c: Column) -> Column:
        out = F.lit(False)
        for kind, w in self.weights.items():
            parts = [F.lit(1.0), *[c[f"v{i}"] for i in range(N_VOTES)], c["size"] / 8.0, c["digits"] / 3.0]
            z = sum((p * F.lit(float(x)) for p, x in zip(parts, w, strict=True)), F.lit(0.0))
            out = out | ((c["kind"] == kind) & (z >= 0))
        return out


def fit(found: DataFrame, rounds: int = 50) -> SpanModel:
    """EM over vote patterns, then the classifier. ``found`` is :func:`find`'s table."""
    c = found.select(F.explode("pii_cands").alias("c")).select("c.*")
    keys = ["kind", *[f"v{i}" for i in range(N_VOTES)], "size", "digits"]
    rows = c.groupBy(*keys).count().orderBy(*keys).collect()  # at most 2 x 16 x 9 x 4 rows
    weights, reliability = {}, {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        v = np.array([[r[f"v{i}"] for i in range(N_VOTES)] for r in own], float)
        n = np.array([r["count"] for r in own], float)
        q = np.clip(v.mean(1), 0.1, 0.9)  # to begin with, the share of yes votes
        hit = miss = np.full(N_VOTES, 0.5)
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            hit = ((n * q) @ v + 4 * 0.8) / (n @ q + 4)
            miss = ((n * (1 - q)) @ v + 4 * 0.2) / (n @ (1 - q) + 4)
            a = np.log(prior) + v @ np.log(hit) + (1 - v) @ np.log(1 - hit)
            b = np.log(1 - prior) + v @ np.log(miss) + (1 - v) @ np.log(1 - miss)
            q = 1 / (1 + np.exp(np.clip(b - a, -60, 60)))
        x = np.column_stack([np.ones(len(own)), v, [r["size"] / 8 for r in own], [r["digits"] / 3 for r in own]])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps of a ridge logistic regression on soft labels
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            w = w + np.linalg.solve(h, x.T @ (n * (q - p)) - w)
        weights[kind] = tuple(np.round(w, 6))
        reliability[kind] = [(float(h), float(m)) for h, m in zip(hit, miss, strict=True)]
    return SpanModel(weights, reliability)


def _both(found: DataFrame, model: SpanModel) -> tuple[Column, Column]:
    """All spans (base and added) and base spans, each in order of kind, then s."""
    added = F.transform(F.filter("pii_cands", model.accepts), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return F.array_sort(F.concat("pii_base", added)), F.array_sort("pii_base")


def detect(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if not asked for) with ``pii_base`` and ``pii_spans`` (base and added), each an array of kind, s, e in order of kind, then s.

    Columns of ``docs`` with these names are replaced.  With texts, these are searched once to fit the model and once more for the
    result, so that none is kept between.
    """
    found = find(docs.drop("pii_spans"))

    def marked(found: DataFrame) -> DataFrame:
        spans, base = _both(found, fit(found))
        return found.withColumns({"pii_spans": spans, "pii_base": base}).drop("pii_cands")

    if keep_text:
        return marked(found)
    with Scratch(docs.sparkSession) as scratch:
        return stored(marked(scratch.kept(found.drop("text"))), "pii-spans")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, of spans that overlap the first; null texts stay null.

    Texts are searched once to fit the model and once more for the result, so that no text is kept between.
    """
    rows = docs.select(F.struct(*[_named(c) for c in docs.columns]).alias("row"), "text")
    found = find(rows)
    spans, _ = _both(found, fit(found))
    d = found.withColumn("pii_order", F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))
    # Where the text goes on after all spans up to each one.
    d = d.withColumn("pii_ends", _running(F.transform("pii_order", lambda x: x["e"]), F.greatest, 0))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # Four bytes a character, so that a place in the text is found without walking to it.
    wide = F.encode("text", "UTF-32")

    def piece(x: Column, i: Column) -> Column:
        begin = F.coalesce(F.get("pii_ends", i - 1), F.lit(0))
        plain = F.decode(F.substr(F.col("pii_wide"), begin * 4 + 1, (x["s"] - begin) * 4), "UTF-32")
        return F.when(x["s"] >= begin, F.concat(plain, F.get(names, x["kind"]))).otherwise("")

    d = d.withColumn("pii_wide", F.when(F.size("pii_order") > 0, wide))
    last = F.decode(F.substr(F.col("pii_wide"), F.element_at("pii_ends", -1) * 4 + 1), "UTF-32")
    text = F.when(F.size("pii_order") > 0, F.concat(F.array_join(F.transform("pii_order", piece), ""), last)).otherwise(F.col("text"))
    return d.select(*[(F.when(F.col("text").isNotNull(), text) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])

"""Quality rules as a short-circuit cascade.

Each rule says when a document fails, as an SQL expression over measures of its text.  On a sample by hash of the id, every
rule's rejections are counted and its cost estimated: the work of its expression and of the measures it needs, in characters read per document times a weight per kind of work.  Rules then run in order of rejections per cost, so most bad
documents meet a cheap, telling rule first and skip the rest (``CASE`` evaluates lazily).  The estimate is a count, not a clock: the same
documents give the same order.  The order changes cost only, never the verdict.

:func:`verdicts` makes a measure only for documents that reach a rule which needs it; :func:`cascade` returns the base measures
of every document and so can skip only what the other rules need.

Null or empty text: no words, all counts 0, rejected by the word count.  Repeated rows and rows without an id: a row each.  Very long texts
are read whole; sorting is done only for texts that have a window twice.  Ties of the order go by name.  An empty table: no rows.  Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
#: Rows of the sample that costs and rejections are taken from, about.
SAMPLE_ROWS = 500
#: Characters a measure reads per document, over n_chars, n_words: each pass of a byte search counts as 1 per character, regular expressions, splits and hashes as what
#: they took beside that when they were measured.
WORK = {
    "n_words": "30 * n_chars", "word_chars": "2 * n_chars", "n_symbols": "8 * n_chars", "n_lines": "10 * n_chars", "n_dup_lines": "12 * n_chars", "n_repeat_words": "30 * n_chars + 300 * n_words",
}


@dataclass(frozen=True)
class Rule:
    """``fails`` over the columns of :func:`measure`; null counts as passing. ``needs`` are its measures and ``work`` what itself reads. ``base`` rules are the contract's own."""

    name: str
    fails: str
    needs: tuple[str, ...]
    work: str = "1"
    base: bool = False


RULES = (
    Rule("few_words", "n_words < 10", ("n_words",), base=True),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words"), base=True),
    Rule("symbols", "2 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", ("n_words", "word_chars")),
    Rule("exclamation", "2 * (char_length(text) - char_length(replace(text, '!', ''))) > n_words", ("n_words",), "n_chars"),
    Rule("shouting", "n_words >= 20 and 2 * char_length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > word_chars", ("n_words", "word_chars"), "30 * n_chars"),
    Rule("few_kinds_of_words", "n_words >= 50 and 20 * size(array_distinct(ws)) < n_words", ("n_words",), "60 * n_words"),
)


def _measures() -> dict[str, Column]:
    """The measures over ``text``, ``ws`` (its words) and ``ls`` (its lines with a word)."""
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return {
        "n_words": F.size("ws").cast("long"), "word_chars": F.length(F.array_join("ws", "")).cast("long"), "n_symbols": (F.length("text") - F.length(bare)).cast("long"),
        "n_lines": F.size("ls").cast("long"), "n_dup_lines": (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"), "n_repeat_words": _repeated(F.col("ws")),
    }


def _repeated(ws: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text."""
    none = F.array().cast("array<bigint>")
    # Each word is hashed once, each window from five of these numbers.
    hw = F.transform(ws, lambda w: F.xxhash64(w))
    hashed = F.transform(F.array(hw), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    hs = F.when(F.size(ws) >= WINDOW, F.get(hashed, 0)).otherwise(none)

    def covered(hs: Column) -> Column:
        # Equal windows stand side by side once sorted.
        so = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(so: Column) -> Column:
            n = F.size(so)
            twin = F.filter(so, lambda e, k: ((k > 0) & (F.get(so, F.greatest(k - 1, F.lit(0)))["h"] == e["h"])) | ((k + 1 < n) & F.coalesce(F.get(so, k + 1)["h"] == e["h"], F.lit(False))))
            return F.array_sort(F.transform(twin, lambda e: e["i"]))

        ps = F.get(F.transform(F.array(so), places), 0)
        gaps = F.transform(F.array(ps), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return F.get(gaps, 0)

    # Only texts that have equal windows go on to find their places.
    counted = F.transform(F.array(hs), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.get(counted, 0).cast("long")


def _texts(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("ws", words(F.col("text"))).withColumn("ls", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text, ws (words) and the counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    ``n_repeat_words`` counts the words that lie in a window of five words found at least twice in the text.
    """
    return _texts(docs).select("doc_id", "text", "ws", *[m.alias(n) for n, m in _measures().items()])


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, best first, with both figures (shares of the sample, characters read per document)."""
    n = docs.count()
    share = min(1.0, rows / max(1, n))
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(13)), F.lit(1 << 20)) < int((1 << 20) * share)) if share < 1 else docs
    with Scratch(docs.sparkSession) as s:
        sample = s.kept(measure(some).withColumn("n_chars", F.length("text")))
        asked = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(r.fails)).alias(f"f_{i}") for i, r in enumerate(rules)], *[F.avg(F.expr(f"double({r.work})")).alias(f"w_{i}") for i, r in enumerate(rules)]]
        got = sample.agg(*asked, *[F.avg(F.expr(f"double({w})")).alias(f"m_{k}") for k, w in WORK.items()]).first()
    out = []
    for i, r in enumerate(rules):
        cost = 1 + (got[f"w_{i}"] or 0.0) + sum(got[f"m_{k}"] or 0.0 for k in r.needs)
        out.append((r, got[f"f_{i}"] / max(1, got["n"]), cost))
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def _first_failure(order: list[Rule]) -> Column:
    case = None
    for r in order:
        hit = F.coalesce(F.expr(r.fails), F.lit(False))
        case = F.when(hit, F.lit(r.name)) if case is None else case.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if case is None else case


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """The columns of :func:`measure` and ``failed_rule``, the first rule in order that rejects (null: none)."""
    order = order or [r for r, _, _ in order_rules(docs, rules)]
    return measure(docs).withColumn("failed_rule", _first_failure(order))


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """doc_id and ``failed_rule`` only: a chain of steps, each of which makes the measures its rule needs first for documents that still pass."""
    order = order or [r for r, _, _ in order_rules(docs, rules)]
    d, made = _texts(docs).withColumn("failed_rule", F.lit(None).cast("string")), set()
    for r in order:
        open_ = F.col("failed_rule").isNull()
        for k in r.needs:
            if k not in made:
                d = d.withColumn(k, F.when(open_, _measures()[k]))
                made.add(k)
        d = d.withColumn("failed_rule", F.when(open_ & F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(r.name)).otherwise(F.col("failed_rule")))
    return d.select("doc_id", "failed_rule")

"""Operators over whole tables and hard inputs: nothing filtered, folded or capped away."""

import random

import numpy as np
from choicefold.llm import mixing, token_counts, url_filter
from choicefold.llm.tokens import encoder, vocabulary
from pyspark.sql import functions as F


def test_mix_fills_past_a_very_long_document(spark):
    """Whatever is left out is larger than what is missing, also when the cut-off falls on a text longer than all others."""
    rng = random.Random(1)
    rows = []
    for s in range(12):
        sizes = [max(1, int(rng.lognormvariate(4, 1))) for _ in range(400)] + [60_000]
        rows += [(len(rows) + i, "a " * n, f"s{s:02}") for i, n in enumerate(sizes)]
    rows += [(r[0], r[1], r[2]) for r in rng.sample(rows, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    by: dict = {}
    for r in mixing.mix(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect():
        by.setdefault(r["source"], []).append(r)
    for got in by.values():
        gap = got[0]["mix_target"] - sum(r["mix_size"] * r["mix_copies"] for r in got)
        whole = int(got[0]["mix_target"] / got[0]["mix_source_size"])
        left: dict = {}
        for r in got:
            if r["mix_copies"] == whole:
                left[r["doc_id"]] = left.get(r["doc_id"], 0) + r["mix_size"]
        assert gap > -1e-6 and (gap < 1e-6 or min(left.values()) > gap)


def test_counts_of_every_prefix(spark):
    """Texts without spaces, with NUL, contractions, special strings and characters that combine."""
    v = vocabulary("word_bpe_49k.json")
    count = lambda t: len(encoder(v, False).tok.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    texts = ["漢字仮名交じり文は、空白なしで続く。" * 5, "".join(rng.choice("ABCabcxyz0189+/=") for _ in range(300)), "a\0b internationalization \0 c d\0", "don't they'll we've x're!!'s 'r 're", "a!<|endoftext|>b<|startoftext|><|endof <|ENDOFTEXT|>", "e\u0301te\u0301 \u0130x \u03a3\u03a3 caf\u00e9s na\u00efve\u00a0x\x1cy\tz", "", "  ", "antidisestablishmentarianism"]
    texts += ["".join(rng.choice("abtheIN'sre .,!1é漢<|> \n") for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = token_counts.prefix_table(docs, v).select("*", token_counts.tokens_before(F.lit(7)).alias("n"), token_counts.cut_at(F.lit(9)).alias("cut")).collect()
    assert len(rows) == len(texts)
    within = {r["doc_id"]: r["budget_tokens"] for r in token_counts.prefix_counts(docs, v, 9).collect()}
    for r in rows:
        t = texts[r["doc_id"]]
        want = [count(t[:i]) for i in range(len(t) + 1)]
        assert (r["counts"], r["ends"]) == (want[1:], list(range(1, len(t) + 1))), t
        cut = max(i for i, c in enumerate(want) if c <= 9)
        assert r["n"] == want[min(7, len(t))] and r["cut"] == cut and within[r["doc_id"]] == want[cut]


def test_suffixes_do_not_share_statistics(spark):
    """Only its suffix tells what becomes of an unruled URL, and there are 6,000 of them."""
    rules = [url_filter.Rule("net", "/es/", True), url_filter.Rule("net", "/en/", False)]
    urls = [(i, f"http://h{i:04}.net/{p}/{k}") for i in range(6000) for p, k in ((("es", "en")[i % 2], 1), (("es", "en")[i % 2], 2), ("fr", 3))]
    pages = spark.createDataFrame([(n, u) for n, (_, u) in enumerate(urls)], "page_id bigint, url string")
    got = [r for r in url_filter.judge(pages, rules).collect() if "/fr/" in r["path"]]
    assert len(got) == 6000 and all(r["verdict"] == ("allow" if int(r["host"][1:5]) % 2 else "block") for r in got)


def test_plain_words_are_counted_many_at_a_time(monkeypatch):
    """Every prefix as the library counts it, for words with shared beginnings, punctuation, contractions and accents, and none of them alone."""
    made = token_counts.Steps(vocabulary("word_bpe_49k.json"))
    rng = random.Random(7)
    words = ["don't", "DON'T've'", "x!'s", "'", "''ll", "nation", "national", "Nationalité", "éÉß", "İ", "ŉſŸ", "a¼b", "a²", "漢", "é", "<|endoftext|>", "a\x85b"]
    words += ["".join(rng.choice(["the", "tion", "é", "Ü", "'s", ".", "7", "%%", "n", "q", "zz", "’", "ª"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    alone = []
    one = made.inner.counts_of
    monkeypatch.setattr(made.inner, "counts_of", lambda w, n: alone.append(w) or one(w, n))
    got = np.cumsum(made.of("\n".join(words)), dtype=np.int64)
    at = base = 0
    for w in words:
        want = [len(made.inner.tok.encode(w[: i + 1], add_special_tokens=False).ids) for i in range(len(w))]
        assert (got[at : at + len(w)] - base).tolist() == want, w
        at += len(w) + 1
        base = got[at - 2]
    assert all(any(ord(c) >= 0x180 or c in "\x85İ¼²" for c in w) or "<|" in w for w in alone), alone

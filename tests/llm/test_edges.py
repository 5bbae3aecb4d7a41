"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefold.llm import ann, components, jaccard, mixing, packing, pii, quality_classifier, quality_rules, token_counts, token_orc, url_filter
from choicefold.llm.common import table_path
from choicefold.llm.tokens import WordEncoder, vocabulary

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, target string, kind string"
WORDS = "the of and to in is that for it was on with as are be this from or by an which".split()


def documents():
    rng = random.Random(4)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(30_000))
    base = [rng.choice(WORDS) + str(i) for i in range(120)]
    texts = [
        None, "", " \n\t ", "one", "a b c", "A  B\u00a0c\x0bd\n\ne", long, long, "x" * 5000, "1" * 4000, "漢字 é́ ² İ ΑΣ. <|endoftext|> <|startoftext|>", " ".join(base), " ".join(base), " ".join([*base[:60], "new", *base[60:]]),
        "mail a.b@c.de, x_y@d.e_f@g.h 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 010-9999 4111 1111 1111 1111 4111-1111-1111-1112 ++49 89 123456-", "#*$%&|<> a|b\na|b\na|b\n\n", "the same five words here " * 9,
    ]
    return [(i, t, None, None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", "z") for i, t in enumerate(texts)] + [(3, "one", None, None, None, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_id(spark):
    return spark.createDataFrame([(None, "some words without an id", None, "s1", None, "x", "y", "z"), (5, None, None, None, None, None, None, None)], SCHEMA)


ROWS = [(r[0], r[1]) for r in documents()]
ONCE = ROWS[:-1]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_encoder_on_odd_texts():
    rng = random.Random(1)
    odd = [t or "" for _, t in ROWS] + ["".join(rng.choice("ab .,'\n\t!é \x1c漢1<|>s\u00a0") for _ in range(rng.randrange(30))) for _ in range(3000)]
    odd += ["x<|endoftext|>y <|endoftext|> z", "don't. it's, they'll", " .a ,b .. ,", "\x00a b", "I'M 'S", "a.\nb", "A\u0301. B"]
    for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = WordEncoder(vocabulary(name), keep)
        ids, per = e.encode(odd)
        at = np.concatenate([[0], np.cumsum(per)])
        for i, t in enumerate(odd):
            assert ids[at[i] : at[i + 1]].tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, empty, no_id):
    path = table_path(spark, "orc")
    token_orc.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    got = token_orc.with_crc(token_orc.read_tokens(spark, path))
    want = brute.op2(ONCE)
    for r in got.collect():
        assert (r["n_tokens"], r["ids_crc32"]) == want[r["doc_id"]][1:]
    starts = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    tok = brute.library("byte_bpe_50k.json")
    assert {r["doc_id"]: r["ids"] for r in token_orc.lookup(spark, path, [4, 10]).collect()} == {i: [*tok.encode(ROWS[i][1], add_special_tokens=False).ids, 2] for i in (4, 10)}
    for other, n in ((empty, 0), (no_id, 2)):
        p = table_path(spark, "orc")
        token_orc.write_tokens(other, p, vocabulary("byte_bpe_50k.json"), 2)
        assert token_orc.read_tokens(spark, p).count() == n


def test_token_counts(docs, empty, no_id):
    v = vocabulary("word_bpe_49k.json")
    want = brute.op3(ROWS)
    got = token_counts.prefix_counts(docs, v, 2048).collect()
    assert len(got) == len(ROWS) and all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == want[r["doc_id"]] for r in got)
    assert token_counts.prefix_counts(empty, v, 1).count() == 0 and token_counts.prefix_counts(no_id, v, 1).count() == 2


def test_prefix_table_is_exact(docs):
    v = vocabulary("word_bpe_49k.json")
    tok = brute.library("word_bpe_49k.json")
    table = token_counts.prefix_table(docs.where("doc_id in (0, 1, 2, 4, 5, 10, 11, 14)"), v)
    for r in table.collect():
        text = ROWS[r["doc_id"]][1] or ""
        for end, count in zip(r["ends"], r["counts"], strict=True):
            assert len(tok.encode(text[:end], add_special_tokens=False).ids) == count
    asked = table.where("doc_id = 11").select(token_counts.tokens_before(F.lit(100)).alias("n"), token_counts.cut_at(F.lit(50)).alias("cut")).first()
    text = ROWS[11][1]
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert asked["n"] == count(text[:100].rsplit(" ", 1)[0]) or asked["n"] == count(text[:100])
    assert count(text[: asked["cut"]]) <= 50 < count(text[: asked["cut"]] + " " + text[asked["cut"] :].split()[0])


def test_prefixes_of_words_by_dynamic_programming():
    v = vocabulary("word_bpe_49k.json")
    tok, c = brute.library("word_bpe_49k.json"), token_counts.PrefixCounter(v)
    rng = random.Random(2)
    words = ["international", "antidisestablishmentarianism", "a", "theandthe", *["".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(1, 25))) for _ in range(40)]]
    for w in words:
        assert c.word(w) == [len(tok.encode(w[: i + 1], add_special_tokens=False).ids) for i in range(len(w))]


def test_mixing(docs, empty, no_id):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and set(got[0].asDict()) == {*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"}
    size: dict = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["mix_size"]
    goal = brute.op4_targets(size)
    for r in got:
        assert r["mix_size"] == len(brute.WORD.findall(r["text"] or "")) and r["mix_target"] == pytest.approx(goal[r["source"]]) and 0 <= r["mix_copies"] <= 3
    assert mixing.mix(empty).count() == 0 and mixing.mix(no_id).count() == 2
    assert mixing.taken(docs).columns == docs.columns


def test_mixing_by_odds(spark):
    """Documents with ten times the odds are taken more often."""
    rows = [(i, "a b c d", "s0" if i < 600 else "s1", i % 2) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, heavy int")
    m = mixing.mix(d, odds=F.when(F.col("heavy") == 1, 10.0).otherwise(1.0))
    by = {r["heavy"]: r["n"] for r in m.where("source = 's0'").groupBy("heavy").agg(F.sum("mix_copies").alias("n")).collect()}
    assert by[1] > 1.5 * by[0] and by[0] + by[1] == pytest.approx(400, abs=2)


def test_jaccard(docs, empty, no_id):
    want = brute.op5(ONCE)
    for r in jaccard.groups(docs, 4, 85).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.groups(empty, 4, 85).count() == 0
    assert rows_of(jaccard.groups(no_id, 4, 85), "doc_id", "component_id") == [(5, 5), (None, None)]
    kept = jaccard.deduplicated(docs, 4, 85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}


@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5), (60, 2)])
def test_jaccard_on_families(spark, percent, n):
    """Families of copies with growing numbers of edits, around the threshold; a common passage in many documents."""
    rng = random.Random(percent)
    word = lambda: "w" + str(rng.randrange(3000))
    rows, passage = [], [word() for _ in range(60)]
    for f in range(12):
        base = [word() for _ in range(rng.choice((3, 8, 20, 60, 150, 400)))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 12)):
                t[rng.randrange(len(t))] = word()
            base = t if rng.random() < 0.3 else base
            rows.append((len(rows), " ".join(t)))
        rows.append((len(rows), " ".join(passage + base[: rng.randrange(1, 10)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), n, percent).collect()}
    assert got == brute.op5(rows, n, percent)


def test_blocked_comparison_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 7)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(80)] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    assert got == brute.op5(rows)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    want = brute.components({x for p in links for x in p}, links)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rules(docs, empty, no_id):
    want = brute.op7(ROWS)
    for r in quality_rules.cascade(docs).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[r["doc_id"]][:5]
        assert r["failed_rule"] is not None or not want[r["doc_id"]][5]
    assert quality_rules.cascade(empty).count() == 0 and quality_rules.cascade(no_id).count() == 2


def test_classifier(spark, docs, empty, no_id):
    labels = spark.createDataFrame([(5, 1), (11, 1), (12, 1), (14, 1), (15, 0), (16, 0), (8, 0), (9, 0), (9, None), (None, 1)], "doc_id bigint, y int")
    scored, model = quality_classifier.classify(docs, labels)
    got = scored.collect()
    assert model is not None and len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none, model = quality_classifier.classify(docs, labels.where("y = 1"))
    assert model is None and {r["score"] for r in none.collect()} == {0.5}
    assert quality_classifier.classify(empty, labels)[0].count() == 0 and quality_classifier.classify(no_id, labels)[0].count() == 2
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_isotonic():
    rng = np.random.default_rng(0)
    y, n = rng.uniform(size=40), rng.integers(1, 9, 40).astype(float)
    fit = quality_classifier.isotonic(y, n)
    assert (np.diff(fit) >= -1e-12).all() and fit @ n == pytest.approx(y @ n)
    # Greatest lower bound of averages gives the same.
    want = [max(min(np.average(y[i : j + 1], weights=n[i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert fit == pytest.approx(want)


def test_packing(docs, empty, no_id):
    v = vocabulary("word_bpe_49k.json")
    want = brute.op9(ROWS)
    got = packing.pack(docs, v, 1, with_ids=True).collect()
    assert all((r["length"], r["ids_crc32"], r["doc_tokens"]) == want[r["doc_id"], r["start"]] and brute.crc(r["ids"]) == r["ids_crc32"] for r in got)
    assert all(r["length"] == 1 << r["bucket"] for r in got)
    assert packing.pack(empty, v, 1).count() == 0 and packing.pack(no_id, v, 1).where("doc_id = 5").count() == 1
    assert packing.lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    with pytest.raises(ValueError):
        packing.pack(docs, v, 1, most=1000)


def test_personal_data(docs, empty, no_id):
    want = {d: s for d, (*_, s) in brute.op10(ROWS).items()}
    got = pii.detect(docs).collect()
    assert len(got) == len(ROWS) and set(docs.columns) <= set(got[0].asDict())
    for r in got:
        assert [(pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["pii_base"]] == want[r["doc_id"]]
    assert pii.detect(empty).count() == 0 and pii.detect(no_id).count() == 2
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[0] is None and red[3] == "one" and "[EMAIL]" in red[14] and "@c.de" not in red[14] and red[6] == ROWS[6][1]


def test_added_spans(spark):
    """Keys after a word for keys are found, plain long words are not."""
    rng = random.Random(5)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{hexed()}" and more') for i in range(30)] + [(100 + i, f"Donaudampfschifffahrt{i} and words") for i in range(60)]
    got = {r["doc_id"]: r["pii_spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all((20, 60) in [(x["s"], x["e"]) for x in got[i]] for i in range(30))
    assert not any(got[100 + i] for i in range(60))


def test_base_patterns_on_random_texts(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab@.-_+%1234567890  ()é") for _ in range(rng.randrange(80)))) for i in range(3000)]
    rows += [(5000 + i, "".join(rng.choice("0123456789 -") for _ in range(60))) for i in range(500)]
    got = {r["doc_id"]: [(pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["pii_base"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: brute.base_spans(t) for d, t in rows}


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/?q", "x://net/fr/", "x://net", "x://sub.net/es/1#f", "http://com/", "a://b://c.net/es/", "http://user@h.com:80/p", "http://org/\nfr/"] + [f"http://h{i}.{t}/{p}/{i}" for i in range(30) for t, p in (("net", "es"), ("com", "en"), ("org", "fr"))]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    rules = [url_filter.Rule("com", "/", False), url_filter.Rule("example.com", "/en/", True), url_filter.Rule("www.example.com", "/en/", False), url_filter.Rule("net", "/es/", True), url_filter.Rule("net", "/fr/", True)]
    from .test_contracts import plain_rule

    for r in url_filter.judge(df, rules).collect():
        host, path, rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = url_filter.Trees().fit(x[:2000], y[:2000])
    assert ((t.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[3]
    rows = [(i, v.tolist(), "c", 0) for i, v in enumerate(x)] + [(400, None, "c", 0), (420, [0.0] * 8, "c", 0), (440, [1.0] * 7, "c", 0), (460, [float("nan")] * 8, "c", 0), (480, [None] * 8, "c", 0), (7, x[7].tolist(), "c", 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cls string, ids int")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 400, 20))
    for i in got:
        s = (x * x[i]).sum(1)
        assert got[i] == [v for v in np.lexsort((np.arange(400), -s)) if v != i][:10]
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, k=10).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert ann.search(df.where("vec_id >= 400"), F.col("vec_id") % 20 == 0).count() == 0


def test_visits_share_one_queue():
    """With no bound on candidates every member is reached once in each tree."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    trees = [ann.grow(x, 5, rng) for _ in range(3)]
    first = np.concatenate([[0], np.cumsum([t.leaves for t in trees])])
    leaf = np.concatenate([first[i] + ann.leaf_of(t, x) for i, t in enumerate(trees)])
    size = np.bincount(leaf, minlength=first[-1])
    hit = ann.visits(trees, first, size, x[0], 10**9)
    assert len(set(hit)) == len(hit) and size[hit].sum() == 3 * 500
    near = ann.visits(trees, first, size, x[0], 1)
    assert near[0] in leaf.reshape(3, -1)[:, 0]


def test_query_table_holds_every_prefix(spark, docs, tmp_path):
    """Not only ends of words and the word where the budget ends: each prefix of each text."""
    v = vocabulary("word_bpe_49k.json")
    some = docs.where("doc_id in (0, 1, 2, 4, 5, 10, 11, 14)")
    token_counts.write_counts(some, v, f"{tmp_path}/steps")
    whole = {r["doc_id"]: r["counts"] for r in token_counts.prefix_table(some, v).collect()}
    got = {r["doc_id"]: np.cumsum(np.frombuffer(bytes(r["steps"]), "<i2")).tolist() for r in spark.read.parquet(f"{tmp_path}/steps").collect()}
    assert got == whole and sum(map(len, got.values())) > 100

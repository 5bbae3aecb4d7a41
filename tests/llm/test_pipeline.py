"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as p

from choicefold.llm import pii
from choicefold.llm.common import stored

from . import brute


def test_stages(spark, sf):
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5 and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    inputs = []
    for name, stage in p.STAGES[:-1]:
        inputs.append(docs)
        docs = stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == cols, name
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    first, second, third, fourth = inputs
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in (first, second, third)]
    assert len(good & ids[0] - ids[1]) <= 0.02 * len(good) and ids[1] < ids[0]
    rows = [(r["doc_id"], r["text"]) for r in second.select("doc_id", "text").collect()]
    assert ids[2] == {d for d, (_, c) in brute.op5(rows, 5, 80).items() if d == c}
    clean = {r["doc_id"]: r["text"] for r in fourth.collect()}
    for d, t in ((r["doc_id"], r["text"]) for r in third.collect()):
        spans = brute.base_spans(t)
        assert (clean[d] == t) == (not spans) or any(f"[{k.upper()}]" in clean[d] for k in pii.KINDS)
        assert not brute.base_spans(clean[d])
    copies: dict = {}
    for r in docs.select("doc_id").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= set(clean)
    packed = p.STAGES[-1][1](spark, docs, sf)
    want = brute.op9([(d, clean[d]) for d in copies])
    got: dict = {}
    for r in packed.collect():
        assert (r["length"], r["ids_crc32"], r["doc_tokens"]) == want[r["doc_id"], r["start"]]
        got[r["doc_id"], r["start"]] = got.get((r["doc_id"], r["start"]), 0) + 1
    assert got == {(d, s): copies[d] for d, s in want}


def test_packing_begins_with_collected_heaps(spark, sf):
    """Before its Python workers take memory, the free heap of earlier stages is given back."""

    def collections() -> int:
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = collections()
    p.packed(spark, docs, sf)
    assert collections() > before

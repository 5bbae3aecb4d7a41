"""From raw documents to packed training sequences, in five stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.

Every stage works on all rows its predecessor kept, whatever other columns they have and whatever their names; an empty table goes
through all of them and comes out without rows.  Null or empty text: scored like an empty text, linked with nothing, without personal
data, of no words and so in the mix only as often as its source's whole copies, and packed as the end id alone.  Rows without an id
are scored, never dropped as copies, mixed as one document, and packed.  Repeated rows: one class of the join, whose smallest id
stays with all its rows.  Ties and very long texts are as the operators' modules say; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicefold.llm import jaccard, mixing, packing, pii, quality_classifier
from choicefold.llm.common import Scratch, give_back_heaps
from choicefold.llm.tokens import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return quality_classifier.accepted(docs, labels.select("doc_id", F.col("quality").alias("y")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id."""
    return jaccard.deduplicated(docs, n=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as many times as it is taken."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two tokens, none across documents."""
    give_back_heaps(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, with_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: A classifier and order sampling are among the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage read is removed once its own result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scratch(spark)
    for name, stage in STAGES[:-1]:
        mine = Scratch(spark)
        docs = mine.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        before.close()
        before = mine
    return STAGES[-1][1](spark, docs, sf_dir)

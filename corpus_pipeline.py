"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all rows its predecessor kept.  Toxic and low-quality documents go, one
document of each near-duplicate group stays, passages that repeat across what is left are cut
out, and the rest is packed into sequences.  All stages but the last return the columns of
``documents``.  Nulls, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievetext.llm.common import BATCHES, stored
from sievetext.llm.packing import pack
from sievetext.llm.paragraphs import drop_repeats
from sievetext.llm.quality import keep_good
from sievetext.llm.simhash import keep_first
from sievetext.llm.toxicity import drop_toxic
from sievetext.session import ship_package


def _ready(spark: SparkSession) -> None:
    """The package on the executors, and texts sent to Python in small batches where the session says nothing else."""
    ship_package(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores at its threshold or above go."""
    _ready(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    _ready(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, that of the smallest doc_id."""
    _ready(spark)
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; their documents stay."""
    _ready(spark)
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    _ready(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: Trained and fingerprinting stages have no SQL twin; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{place}")
    return docs

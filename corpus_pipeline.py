"""A corpus pipeline: quality rules, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. No stage reads anything but docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import mixing, packing, pii, quality_rules, simhash
from seqloom.llm.common import collecting, fresh, remove, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    verdict = fresh(docs, "_quality")
    return quality_rules.judge(docs, verdict).filter(F.col(verdict)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become their kind, disclosing terms [term]."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; what a stage wrote for itself, and the result before it, is deleted then."""
    docs, stale = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with collecting() as made:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with collecting() as own:
                docs = written(docs)
            remove(spark, stale + made)
            stale = own
    return docs


#: The posterior and the fingerprints come from iterations and a hash that SQL lacks; the test of the
#: pipeline holds its rows against plain Python.
ORACLE_SQL = None

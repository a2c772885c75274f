"""A corpus from raw documents to packed bins, in five stages.

Each stage works on all rows that the one before it kept. Between stages the
rows are written as Parquet in the shared folder.

Every stage but the last returns the columns that it was given. An empty table
passes through all of them; a null text counts as empty, so quality rules reject
it, and a stage that meets one nevertheless keeps it as it is. Repeated rows are
equal texts: one stays after near-dedup. Texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.decontamination import without_contaminated
from engrama.llm.packing import pack
from engrama.llm.probminhash import representatives
from engrama.llm.quality_ledger import STRICT, apply_policy, ledger
from engrama.llm.secret_battery import redact
from engrama.llm.shared import drop, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy keeps."""
    return apply_policy(ledger(docs), STRICT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = stash(stage(spark, docs, sf_dir))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, components and sequential packing are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

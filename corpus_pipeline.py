"""From raw documents to packed training sequences, one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
works on all documents that its predecessor kept. All but the last return the
columns of ``documents``. ``run`` writes what a stage returns as Parquet below
the shared checkpoint folder and gives the next stage that table, so a lost
executor never sends the work back beyond the last stage. The stage tables lie
in the session's scratch folder and end with the session.

Defined results: documents with a null or empty text fail the quality rules and
go; a null id is kept through all stages, and of a component the document of the
least known id stays; repeated rows are near duplicates of each other, so one
stays; an empty table gives an empty result with the same columns; extra columns,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citysense.llm.decontaminate import remove_documents
from citysense.llm.line_quality import clean_documents
from citysense.llm.packing import pack
from citysense.llm.secret_scan import redact
from citysense.llm.simhash import drop_near_duplicates
from citysense.llm.store import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of noise, navigation and boilerplate go, and documents that the rules reject."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that of the least id."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; all others stay as they are."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Fingerprint components and token ids have no form in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: STAGES in order, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns documents with the columns it
got; the last returns the pieces of the packed sequences. ``run`` writes each
stage's result to the shared folder and reads it back for the next.

doc_id identifies a document: rows that share one stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import decontaminate, lines, packing, quality, simhash
from evq.llm.scratch import Scratch, table


def _except(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the documents in ``gone`` (doc_id)."""
    scratch = Scratch(docs.sparkSession, name)
    gone = scratch.save(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone").hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _except(docs, quality.judge(docs).where(~F.col("kept")), "stage-quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document that loses its last word that way goes, one that had none stays."""
    rows = lines.dedup(docs)
    lost = F.col(rows.columns[-1])
    rows = rows.where((lost == 0) | F.col("text").isNotNull())
    kept = {c: F.col(c) for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(lost > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*kept.values())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest doc_id."""
    return _except(docs, simhash.groups(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "stage-simhash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return _except(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "stage-decontaminate")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SimHash, edit similarity and tokens have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

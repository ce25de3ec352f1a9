"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents`` (and any others, whatever their names); what a
stage rejects is gone for the next. Texts are taken whole at every stage, and an empty table passes through as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm import decontam, line_dedup, near_dup, packing, quality
from siteglass.llm.common import drop, drop_work, table, work_dir, work_made
from siteglass.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the line-first rules reject, and the failing lines of the others.

    Null and empty texts have too few words and go. Equal rows are judged alike; rows with a null doc_id are judged too.
    """
    return quality.clean(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that (nearly) repeat an earlier one, of any length; documents without a word left go.

    The line with the smallest doc_id and number stays. Rows that repeat a doc_id and text are one document and stay
    alike; those with a null doc_id pass as they are; a null text has no lines and stays null.
    """
    return line_dedup.clean(docs, line_dedup.Params(fold_short=True))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of near duplicates, by shingles of five words at a similarity of 0.8.

    A group is what links connect. Rows that repeat the doc_id kept are kept as often as they come; texts without
    words and rows with a null doc_id link with nothing and stay.
    """
    gone = near_dup.near_duplicates(docs, near_dup.Params(words=5)).where("not kept").select("doc_id").distinct()
    return docs.alias("docs").join(gone.alias("gone"), F.col("docs.doc_id") == F.col("gone.doc_id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none and stay; equal rows are judged alike; items without words are held by nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences, one row a piece.

    Null text is the end id alone; repeated rows are packed as often as they come.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("near_dedup", near_deduplication), ("decontamination", decontamination), ("packing", pack)]

#: Token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the table the one before it wrote.

    Once a stage has written, its own work tables and the table before it are deleted.
    """
    docs, folder, last = table(spark, sf_dir, "documents"), work_dir(spark), None
    made = work_made()
    for name, stage in STAGES:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_work(spark, made)
        if last:
            drop(spark, last)
        last = path
    return docs

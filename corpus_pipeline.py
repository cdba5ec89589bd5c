"""The training-data pipeline: quality, line dedup, near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import linededup, mixing, ngramjoin, pieces, quality
from gritstone.llm.queries import PIECE_MODEL, crc_remainder
from gritstone.llm.shared import drop, read, save


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels outside the held-out fold."""
    return quality.without_rejected(docs, read(spark, sf_dir, "labels").where(crc_remainder("doc_id", 4) != 2))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has in an aligned block go, and with them documents of which nothing but blanks is left; n_chars follows the
    text."""
    cut = linededup.dedup_lines(docs)
    emptied = (F.col("_deleted") > 0) & F.col("text").rlike(r"^\s*$")
    n_chars = F.when(F.col("_deleted") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, a similarity of 0.8) the document with the least doc_id stays."""
    return ngramjoin.one_of_each_group(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source with the same share, as many documents as came in on average, in a random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids."""
    return pieces.encode(docs, pieces.Pieces.load(PIECE_MODEL)).withColumnRenamed("_ids", "ids").withColumn("n_tokens", F.size("ids"))


STAGES = [("quality", good_documents), ("line dedup", fresh_lines), ("near duplicates", one_of_each_group), ("mixing", mixed), ("encoding", encoded)]

#: Discriminants, alignments and byte-pair merges are beyond SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

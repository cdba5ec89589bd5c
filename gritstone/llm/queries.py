"""One query for each operator, over its whole table, in the columns that the query promises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, imatch, linededup, lm, mixing, ngramjoin, passages, pieces, quality, treaps, urlfilter
from .shared import read

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of op8_url_filter.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def crc_remainder(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(crc_remainder("doc_id", 4) != 2)
    scored = quality.classify(read(spark, sf_dir, "documents"), labels, threshold=0.7)
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


#: Where the public tokenizers lie, on the driver; the vocabulary travels with the tasks.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces.Pieces.load(PIECE_MODEL), check=True)
    return encoded.select("doc_id", F.size("_ids").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_exact").alias("round_trip"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_groups(read(spark, sf_dir, "documents"), size=4, percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted")
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    return lm.score(documents, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urlfilter.judge(read(spark, sf_dir, "pages"), outcomes, URL_RULES, least=0.85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", F.col("_copy").alias("copy"), F.col("_key").alias("order_key")
    )


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op11_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


WORD_MERGES, BYTE_MERGES = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, bpe.Bpe.load(WORD_MERGES), ids=False, packed=True, decoded=True)
    return encoded.select(
        "doc_id", (F.octet_length("_packed") / 4).cast("bigint").alias("n_tokens"), F.sha2("_packed", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = bpe.Bpe.load(BYTE_MERGES, special=False), pieces.Pieces.load(PIECE_MODEL)
    aligned = align.align(docs, a, b, groups="_groups_sha256", keep_text=False)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return aligned.select("doc_id", *[F.col(f"_{c}").alias(c) for c in columns])


QUERIES: dict[str, Query] = {
    "op1_imatch": op1_imatch,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_ann": op6_ann,
    "op7_lm_score": op7_lm_score,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_passages": op10_passages,
    "op11_treaps": op11_treaps,
    "op12_bpe": op12_bpe,
    "op13_align": op13_align,
}

"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's input.

Language ID removes documents in no learned language; line dedup deletes later copies of line runs and drops documents
of which nothing is left; of each class of near-duplicates one document stays; documents that hold a benchmark item
go; the rest is encoded. All but the last stage return the columns of documents, with n_chars as text has them.

Null and empty texts go in the first stage, as do texts without a letter. Null and repeated ids, repeated rows, empty
tables and very long texts are as each stage's operator defines; further columns are carried through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwarden.llm import bpe, decontaminate, langid, lines, ngram_join
from sparkwarden.llm.common import Scratch, internal, result

#: A text of so many bytes or more whose best language needs more bits a byte is in none of the learned ones (8 bits is
#: no model at all). Shorter texts say too little for that.
MIN_BYTES, MAX_BITS_PER_BYTE = 200, 7.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are ``und``, or long enough to judge and hardly compressed by any language's model."""
    pred, bits = internal(docs, "lang_pred"), internal(docs, "bits_per_byte")
    judged = langid.identify(docs)
    foreign = (F.octet_length("text") >= MIN_BYTES) & (F.col(bits) > MAX_BITS_PER_BYTE)
    return judged.where((F.col(pred) != "und") & ~foreign).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; a document stays if it lost none, or if a word is left."""
    removed = internal(docs, "n_removed")
    out = lines.dedup_lines(docs).where((F.col(removed) == 0) | (F.trim("text") != "")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the least id.

    Line dedup leaves of a near copy only the lines in which it differs, which are like nothing else. So classes are first
    decided on the texts that the documents had before (those of the documents table with their ids), then, among those that
    stay, on the texts as they are. Documents that the table does not have are decided on the latter.
    """
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = table.select("doc_id", "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("i")).distinct()
    if not whole.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.count("*").alias("n")).where("i is null or n > 1").isEmpty():
        return _without_ids(spark, docs, table, sf_dir)
    copies = ngram_join.classes(whole, among=ids).groupBy("i").agg(F.bool_and(~F.col("class_i").eqNullSafe(F.col("i"))).alias("copy")).where("copy")
    return ngram_join.keep_one(docs, among=ids.join(copies, "i", "left_anti")).select(*docs.columns)


def _without_ids(spark: SparkSession, docs: DataFrame, table: DataFrame, sf_dir: str) -> DataFrame:
    """``near_duplicates`` where ids are null or repeated, so that they do not say which text a document had before: the stages before this one are run again and carry its hash."""
    before = internal(table, "before")
    made = table.withColumn(before, F.xxhash64(F.col("text").cast("string")))
    row = [F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("h")]
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            if stage is near_duplicates:
                break
            made = scratch.write(stage(spark, made, sf_dir), name)
        rows = scratch.write(docs.select(*row).distinct(), "rows")
        same = lambda a, b: a["i"].eqNullSafe(b["i"]) & (a["h"] == b["h"])
        were = made.select(*row, F.col(before).alias("was")).distinct()
        were = scratch.write(were.join(rows, same(were, rows), "left_semi"), "were")
        found = ngram_join.classes(table.select("doc_id", "text"), among=were.select("i", F.col("was").alias("h")).distinct())
        first = found.where("i <=> class_i and h = class_h").select("i", "h").distinct()
        stays = were.join(first, were["i"].eqNullSafe(first["i"]) & (were["was"] == first["h"]), "left_semi").select("i", "h").distinct()
        stays = scratch.write(stays.unionByName(rows.join(were, same(rows, were), "left_anti")), "stays")
        return result(ngram_join.keep_one(docs, among=stays).select(*docs.columns), "near_duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and how many."""
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL cannot express language ID and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: doc_id, ids and n_tokens of every document that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            out = scratch.write(stage(spark, docs, sf_dir), name)
            if name != STAGES[0][0]:
                scratch.drop(docs)
            docs = out
        return result(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])

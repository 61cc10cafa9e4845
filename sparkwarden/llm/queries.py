"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, fim, langid, lines, ngram_join, quality, search, substrings, suffixes, urls, wavelet


def _over(table: str, op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": _over("documents", ngram_join.op1),
        "op2_decontaminate": lambda spark, sf_dir: decontaminate.op2(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op3_chat_format": lambda spark, sf_dir: chat.op3(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op4_byte_bpe": _over("documents", bpe.op4),
        "op5_line_dedup": _over("documents", lines.op5),
        "op6_language_id": _over("documents", langid.op6),
        "op7_url_filter": _over("pages", urls.op7),
        "op8_substring_dedup": _over("documents", substrings.op8),
        "op9_suffix_array_dedup": _over("documents", suffixes.op9),
        "op10_quality_rules": _over("documents", quality.op10),
        "op11_ranked_search": lambda spark, sf_dir: search.op11(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op12_wavelet_tokens": _over("documents", wavelet.op12),
        "op13_fill_in_middle": _over("documents", fim.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat.OP3_SQL, "op5_line_dedup": lines.OP5_SQL, "op7_url_filter": urls.OP7_SQL, "op8_substring_dedup": substrings.OP8_SQL, "op10_quality_rules": quality.OP10_SQL, "op11_ranked_search": search.OP11_SQL, "op13_fill_in_middle": fim.OP13_SQL}

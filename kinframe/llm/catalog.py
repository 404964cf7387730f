"""The text operators' queries, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: The vocabulary file of bytes; a parameter of the operators, never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The second vocabulary, of pieces.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.bpe import bpe_codec

    return bpe_codec(table(spark, sf_dir, "documents"), VOCABULARY)


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.site_style import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm._work import fresh_path
    from kinframe.llm.token_store import read_tokens, write_tokens

    path = write_tokens(table(spark, sf_dir, "documents"), VOCABULARY, fresh_path(spark, "tokens", keep=True))
    return read_tokens(spark, path)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.ngram_join import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm._work import fresh_path
    from kinframe.llm.warc import read_warc, write_warc

    base = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc", keep=True), min_payload_bytes=0)
    return read_warc(spark, base)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=50)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.quality import fit, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.time_partitions import clicks_in_time

    return clicks_in_time(table(spark, sf_dir, "clicks"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.token_align import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), VOCABULARY, PIECES).documents


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinframe.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), VOCABULARY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_site_style": op1_site_style,
        "op2_pii": op2_pii,
        "op3_token_store": op3_token_store,
        "op4_ngram_join": op4_ngram_join,
        "op5_warc": op5_warc,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_bpe": op9_bpe,
        "op10_quality": op10_quality,
        "op11_time_partitions": op11_time_partitions,
        "op12_token_align": op12_token_align,
        "op13_packing": op13_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {}

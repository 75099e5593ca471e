"""The registered queries of the corpus operators: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statewalk.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.dedup import report

    return report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.embeddings import classes

    return classes(table(spark, sf_dir, "embeddings"))


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.toxicity import fold

    return fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.simhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.quality import fold

    return fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.languages import fold

    return fold(table(spark, sf_dir, "documents"))


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.fingerprints import edited

    return edited(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.infilling import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statewalk.llm.codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup,
        op2_byte_bpe,
        op3_harmonic_packing,
        op4_embedding_collisions,
        op5_toxicity_mil,
        op6_simhash_pivots,
        op7_quality_bayes,
        op8_language_mixture,
        op9_license_digest,
        op10_multiset_fingerprint,
        op11_sentencepiece,
        op12_fill_in_middle,
        op13_vector_codes,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from statewalk.llm import codes, infilling, licenses

    return {"op9_license_digest": licenses.oracle(), "op12_fill_in_middle": infilling.oracle(), "op13_vector_codes": codes.oracle()}

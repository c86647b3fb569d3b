"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import chat, codebooks, mixing, spelling
from foliograph.llm.shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.langid import language

    return language(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliograph.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.quality_fm import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings, and the matches of every one whose id is divisible by 50."""
    from foliograph.llm.media import aligned, recordings

    return aligned(recordings(table(spark, sf_dir, "embeddings")), "id % 50 = 0")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.llm.suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_bpe, op4_minhash_dedup, op5_pii, op6_quality_rules, op7_mixing, op8_quality_classifier, op9_media, op10_suffix_dedup, op11_chat, op12_spelling_variants, op13_vector_codes)}
ORACLES: dict[str, str] = {"op7_mixing": mixing.ORACLE, "op11_chat": chat.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_vector_codes": codebooks.ORACLE}

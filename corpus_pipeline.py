"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens. Every stage works on all that the one before kept.

Each stage keeps the columns of ``documents`` and any others, but for the last, which returns its own. Rows whose id or text
is null go through like others; an empty table stays empty; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm.shared import checkpointed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts. Null and empty texts are judged by length alone; equal texts alike."""
    from foliograph.llm.quality_fm import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more; the smallest id stays.

    Null ids, null texts and texts without a word are in no group and stay; so do all rows of an id that stays.
    """
    from foliograph.llm.neardup import one_of_each

    return one_of_each(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind. A null text stays null."""
    from foliograph.llm.pii import redacted

    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the sources' target weights; every document at least once, rare sources more often.

    A null source is a source; a text without a word counts one token.
    """
    from foliograph.llm.mixing import mixed

    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every drawn document as token ids, with digests of the ids and of what they decode to. A null text has no ids."""
    import public_tokenizers

    from foliograph.llm.bpe import encode_decode

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("minhash_dedup", deduplicate), ("pii", privacy), ("mixing", mix), ("bpe", tokens)]
#: learned models, hashing and Python decide most stages, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs

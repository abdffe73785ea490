"""A training-data pipeline of five stages; each calls an operator of the library on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import op1_quality, op3_decontaminate, op5_bpe, op7_language, op9_minhash
from folioscope.llm.common import materialise, pages_of

#: A language whose share of the probability is below this is no clear language.
CLEAR = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier predicts to be good.

    Null and empty texts score 0 and go. Rows that repeat are judged alike; other columns pass through. Without labels all go; an empty table stays empty."""
    model = op1_quality.fit(docs, pages_of(spark, sf_dir, "labels"))
    return docs.where(op1_quality.quality_column(spark, model) >= op1_quality.REJECT)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language, told with a share of CLEAR or more.

    Texts that are null or have no letter go. Ties go to the language that sorts first. Without any lang to learn from all go."""
    import public_tokenizers

    model = op7_language.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = op7_language.language_column(spark, model)
    return docs.where((found["lang_pred"] != op7_language.UNKNOWN) & (found["score"] >= CLEAR))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies (five-word shingles, 0.8).

    Rows that repeat stay once. Texts without words are in no group: one row stays of each doc_id. A null doc_id stays if no equal text has one."""
    return op9_minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks.

    Null and empty texts stay; items without words drop nothing; with an empty benchmark all stay."""
    return op3_decontaminate.without_leaks(docs, pages_of(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document; a null text counts as empty."""
    import public_tokenizers

    return op5_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: No stage of these can be said in SQL but near-dedup. tests/llm holds run(), and each stage on what the one before it kept,
#: against a plain chain of the five stages on one machine.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again before the next."""
    docs = pages_of(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs

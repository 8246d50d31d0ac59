"""Stages from raw documents to packed training sequences.

Each stage works on all that the one before it kept and returns the columns of documents, but for the last, which returns
the pieces of each document with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import drop_written, load, written_alone
from cinderfold.llm.jaccard import without_similar
from cinderfold.llm.language_id import fit, in_known_languages
from cinderfold.llm.mixing import in_training_order
from cinderfold.llm.packing import pack, pieces
from cinderfold.llm.pii import key_of, with_surrogates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are in one of the languages learned from their own labels; lang becomes the language found.

    Rejected are null and empty texts, those without letters, and those that no language's code makes shorter. Equal codes
    go to the first language by code point, repeated rows fare alike, and a table without labels keeps no row.
    """
    return in_known_languages(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (0.8 of their five-word shingles or more), that with the smallest doc_id.

    Null doc_ids come last, ties go by the row's key, and of repeated rows one stays. Null texts are empty, and all texts
    without words are one group. An empty table stays empty.
    """
    return without_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates under the session's key; n_chars follows the new text.

    Null texts stay null, empty ones empty; every row stays, and repeated rows fare alike. An empty table stays empty.
    """
    out = with_surrogates(docs, key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources does, in training order.

    A null source is a source, the last one. Documents without words, null texts too, are kept once; rows repeated in
    doc_id and text count as one; ties go by size and key. An empty table stays empty.
    """
    return in_training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what was taken into sequences of at most 2048 tokens.

    Null and empty texts are the end token alone; a document that was taken again gives its pieces again. Ties in length
    are broken by hash. An empty table gives no sequence.
    """
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: Statistical languages, MinHash and sum-of-squares packing have no SQL; the pipeline is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents, each written as Parquet and read again by the next."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

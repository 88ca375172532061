"""A corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are blacked out, sources are mixed to target weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and, but for the last, returns the columns of `documents`.  All stages take null
ids, texts and sources, empty and very long texts, rows that repeat, empty tables,
and columns beside those of `documents`, whatever their names, which they carry along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stateforge.llm import bpe, jaccard, kit, mixing, secrets, toxicity

#: From this score on a document is rejected; near copies share this per cent of their shingles of so many words.
TOXIC, PERCENT, WORDS = 0.3, 80, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC, by a model of the labelled rows that may be learnt from.

    Every row is judged by its text alone: repeated rows go or stay together, null and
    empty texts have the score of a text without words, and a null id is no
    obstacle.  Without labels of both kinds all scores are the base rate.
    """
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, weights, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies.

    A null id is larger than any other.  Of rows equal in id and set of shingles one
    stays (any one, in all its columns); texts without words are nobody's copies and all stay.
    """
    return jaccard.representatives(docs, words=WORDS, percent=PERCENT)


def black_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text.

    No row goes; a null text stays null and its n_chars as it was.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times).

    A null source is a source of its own.  Rows equal in id, source and text are one
    document, drawn as often as all of them together, with the columns of one of
    them; documents without words stay once.  Ties in the seeded order go by id.
    """
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document drawn, a row each; a null text is empty."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", black_out_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the learnt stage nor the compressor; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kit.written(stage(spark, docs, sf_dir), name, compact=False)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: language, near-duplicates, benchmark passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and reads all its predecessor kept, as Parquet in the shared folder. Stages one to
four return the columns of the documents; the last returns one row per packed piece.

Defined cases, of every stage: an empty table gives no rows; null and empty texts, and texts without letters, go in the first
stage; a null id is an id like any other and joins null-safely; repeated rows are documents of their own, but of rows that
share an id and lie in one component of near-duplicates either all stay or all go, as an id names one document; ties between
near-duplicates go to the least id; texts of any length are read whole and packed in pieces; further columns are handed
through, whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postingworks.llm import decontamination, language, minhash, packing, pii
from postingworks.llm.common import read
from postingworks.llm.registry import prepared
from postingworks.llm.tokens import tokenizer_path
from postingworks.session import configure, materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without any letter go. Where no row says its language, all with letters stay."""
    prepared(spark)
    return language.accepted(docs, language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (five-word shingles, likeness 0.8)."""
    prepared(spark)
    return minhash.kept(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    prepared(spark)
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    prepared(spark)
    return pii.redacted(docs, pii.fit(docs), length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and its place there."""
    prepared(spark)
    return packing.digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", redacted),
    ("packing", packed),
]

# no SQL for language models, MinHash or tokenizers: the tests hold the run against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again for the next."""
    configure(prepared(spark))
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all that the one before it kept, keeps the columns of ``documents`` (but the last, which returns packed
pieces), and reads other tables from ``sf_dir``.  Part of subpackage llm.

Edge cases.  Language: null texts and texts without a letter are rejected, as the operator says.  Near-duplicates: a row is known by
doc_id and text, so rows without a doc_id, or with equal ones, stay unless their texts are similar; of repeated rows one stays; null and
empty texts are alike.  Decontamination: a null text holds no item; rows whose doc_id a found one shares go with it, null doc_ids too.
Secrets: a null text stays null.  Packing: a null text is one piece with the end id.  Extra columns are carried along, whatever
their names; names in another case are taken as Spark does; an empty table gives an empty result.  Texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import decontaminate, language_id, packing, secret_scan, simhash
from tallyfold.llm._common import Workspace, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model rejects; ``lang`` becomes the predicted language."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of texts with a 5-word similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens in sequences of at most 4096."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither language models nor SimHash nor tokenizers.  The tests hold language models, near-duplicates, decontamination
#: and packing against brute force, and the secrets' base spans against a plain scan.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.  What a stage was made from is deleted once its result is written."""
    work = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        known = len(Workspace.made)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs)
            for used in Workspace.made[known:]:
                used.clear()
            if before is not None:
                work.drop(before)
            before = docs
    return docs

"""A corpus from raw documents to packed sequences: toxic documents go, documents in no language go, of near copies one
stays, and what is left is tokenized and packed. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import langid, neardup, packing, toxicity
from nearfield.llm.base import Scratch, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain, learned from ``labels``, does not flag as toxic; all columns stay."""
    return toxicity.unflagged(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language among those learned from ``docs``; all columns stay.

    Null texts, texts without letters and those that the parse finds in no learned language go. If no language can be
    learned, nothing goes for want of one but those.
    """
    return langid.identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id; all columns stay."""
    return neardup.without_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_dedup", drop_near_copies), ("packing", pack)]
#: SQL has neither the models nor the tokenizer of these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder before the next reads it.

    An empty table gives no rows. A table goes when the next one is written or a stage fails; the pieces stay until the
    driver exits.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            scratch = Scratch(spark, f"pipeline-{name}")
            before, last = scratch, before
            try:
                docs = scratch.write(stage(spark, docs, sf_dir), name)
            finally:
                if last:
                    last.drop()
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
    finally:
        if before:
            before.drop()

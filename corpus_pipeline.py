"""From raw documents to packed training sequences, each stage written as Parquet and read again by the next.

quality: documents that the subword classifier rejects go. near_duplicates: one document of each class stays. personal_data: spans are
replaced by marks. mix: documents are repeated or left out so that each source comes near its target. pack: the pieces
of token sequences, packed.

Defined cases. Nulls in any column, empty and very long texts: each stage treats them as its operator says; a null text is scored as an empty one,
is a near duplicate of nothing but its own repeated row, and stays null until it is packed as the end id alone, if it stays. Ties and repeated rows: one row of each
class stays. Documents without an id are documents like others. Extra columns stay up to the last stage, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import mixing, neardup, packing, pii, quality
from skylattice.llm.common import delete, delete_at_end, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express the learnt stages; tests compare run() with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table goes when the next one is written, the last one when the driver's Python ends."""
    docs, base, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    delete_at_end(spark, base)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{base}/{k}-{name}")
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(out), out
    return docs

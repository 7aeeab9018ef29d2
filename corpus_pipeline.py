"""The corpus pipeline: documents, filtered, deduplicated, sanitised, mixed and encoded.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty one; null and
empty texts count as texts without words, and whole texts are read however long they are;
rows that are repeated, or share an id, are rows of their own unless a stage says otherwise;
extra columns come through unchanged whatever their names (the last stage returns its own columns only).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from powerlens.llm import mix, pieces, pii, simhash, toxicity
from powerlens.llm.common import stored, table
from powerlens.llm.queries import MIX, SIMHASH_DISTANCE, SIMHASH_SHINGLE

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under the rejection bound.

    Null and empty texts stay; equal texts share one verdict; a severity equal to the bound goes."""
    return toxicity.keep_mild(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links, that with the smallest id.

    Repeated rows are one group, and so are all texts without a word (fingerprint zero)."""
    return simhash.keep_one(docs, SIMHASH_SHINGLE, SIMHASH_DISTANCE)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it replaced; n_chars follows the text.

    A null text stays null and keeps its n_chars; other texts without such spans stay as they are."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources as often as their weight asks.

    Rows without a source are a source of their own; an empty text is as much a document as any."""
    return mix.mixed(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id, source, piece ids and their number (null and empty texts: no ids)."""
    coded = pieces.encode(docs, public_tokenizers.path(PIECES))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", sanitise),
    ("mix", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # regression, hashing and piece encoding have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

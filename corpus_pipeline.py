"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

toxicity (rejected documents go) -> n-gram Jaccard join (one document of each group stays) ->
substring dedup (recurring passages go) -> mixing sources (the documents in mix order) ->
byte-level BPE (token ids, each document with its position in the mix).

The order of rows in files is not kept by later reads and shuffles, so the mix is the column
``position`` of the result: sorted by it, every prefix has the target shares of the sources.

Every row is a document of its own: rows that share an id are judged by their texts, and rows with
a null id stay rows with a null id.  Null and empty texts pass all stages and have no tokens; null
sources share one stream of the mix; null languages and lengths pass by.  Very long texts are read
whole.  Of equal texts one stays, the one with the smallest id.  Extra columns go through the
filtering stages whatever their names.  An empty table gives an empty result, and without labels
nothing is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, mixing, ngram_join, queries, substring_dedup, toxicity
from lexloom.llm.storage import materialize, table

#: SQL can't train the classifier of the first stage.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring passages of 35 words and more; ``n_chars`` follows the text."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix."""
    return mixing.in_mix_order(docs, queries.SOURCE_WEIGHTS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, position, n_tokens, ids)`` of every document.

    The schedule depends on ids and sources only, so it gives the positions of the mixing stage again.
    It is written down because the encoding must find its rows in the same order when it is run again.
    """
    placed = materialize(mixing.schedule(docs.select("doc_id", "source", "text"), queries.SOURCE_WEIGHTS).select("doc_id", "text", "position"), "placed")
    out = bpe.encode(placed, public_tokenizers.path(queries.BPE_RANKS), place="position")
    return out.select("doc_id", "position", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

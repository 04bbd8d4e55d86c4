"""The corpus pipeline: each stage works on all that the one before it kept.

Documents that score as toxic go; of each group of near duplicates one document stays; passages that repeat are cut
out of the texts; documents that hold a benchmark item go; the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm import decontaminate, minhash, packing, suffix, toxicity
from rillcep.llm.common import staged, table

#: Words of a repeated passage: over fifty.
PASSAGE = 51


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.7 or more by a model of all labelled documents.

    Null and empty texts score the model's bias alone, which is under that, and stay; so does all where labels confirm
    no toxic document. Rows of a null doc_id are scored like others."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, *docs.columns, name="rill_score").where("rill_score < 0.7").drop("rill_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked at similarity 0.8; of repeated rows (one doc_id, one text) one.

    Rows of different texts that share a doc_id stand and fall together. Rows without a doc_id aren't linked: of those
    of one text one stays. Texts without words are never near others."""
    kept = minhash.near_duplicates(docs, threshold=0.8).where("kept").select(F.col("doc_id").alias("rill_kept")).distinct()
    own = {"rill_hash": F.xxhash64("text"), "rill_length": F.length("text")}
    named = docs.where("doc_id is not null").join(kept, docs["doc_id"] == kept["rill_kept"], "left_semi")
    named = named.withColumns(own).dropDuplicates(["doc_id", *own])
    return named.unionByName(docs.where("doc_id is null").withColumns(own).dropDuplicates(list(own))).drop(*own)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of PASSAGE words or more that occurs again, in this document or another, out of the texts.

    All its places are cut, the first as well. No document is dropped; one that was all passage stays, empty. A null
    text stays null."""
    return suffix.without_repeats(docs, width=PASSAGE, unit="words")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item was found; rows are told apart by doc_id (null like any other) and text."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id").alias("rill_id"), F.col("text_hash").alias("rill_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["rill_id"]) & (F.xxhash64(docs["text"]) == found["rill_hash"]), "left_anti")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its token ids. Every row is packed, a null or empty text as its end alone; doc_id may be null."""
    return packing.pack(docs, context=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: SQL can't express trained models, hashing or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

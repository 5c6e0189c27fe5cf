"""From documents to packed training sequences: toxicity, near duplicates, repeated passages, packing.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, and all but the last return
the columns of documents. run() applies them to the documents of a folder; between stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import minhash, packing, phrases, toxicity
from tidewater.llm.common import free_name, reachable, table, written

#: SQL can't express a trained classifier or the tokenizer; tests/llm/test_pipeline.py checks run() against plain Python.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, unchanged, whatever columns they have.

    Null and empty texts are scored like any other; repeated rows get equal scores, so all of them go or stay; null
    doc_ids are never labelled; an empty table stays empty. Without a toxic and a clean training row there is nothing to
    tell documents apart by, and all of them stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not toxicity.learnt(model):
        return docs
    name = free_name(docs, "toxicity_score")
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8), unchanged.

    Documents without words and rows without a doc_id are in no group and stay. Of rows that repeat a doc_id one stays:
    that with the first text in Spark's order (null last), and of equal texts the first by the other columns as JSON.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    order = F.struct(F.col("text").isNull().alias("none"), F.col("text"), F.to_json(F.struct(*(c for c in docs.columns if c != "text"))).alias("rest"))
    # Combined before its shuffle, so that rows that repeat one doc_id are no large group.
    one = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word windows that also start in a document with a smaller doc_id; n_chars follows the text.

    Texts that lose no word stay as they are; the others are their kept words joined by one blank. Null texts have no
    words; null doc_ids count as larger than all others; rows that repeat a doc_id don't count as each other's repeats;
    an empty table stays empty. All other columns stay, whatever their names.
    """
    names = tuple(free_name(docs, n) for n in ("n_words", "n_removed"))
    cleaned = phrases.repeated_windows_removed(docs, size=13, keep_clean=True, counts=names).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, as in packing.pack().

    Null and empty texts are one end token; rows that repeat a doc_id and null doc_ids are packed each; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each_group), ("repeated_passages", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of a folder; each stage's docstring says what becomes of nulls, ties and empty tables."""
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

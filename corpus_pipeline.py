"""Corpus pipeline: toxicity, quality rules, near-duplicate join, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. `run` writes each stage's rows as Parquet under the shared checkpoint folder and rereads
them, so a lost executor costs at most the stage it was in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrymap.llm.common import materialize
from quarrymap.llm.ngram_join import keep_one
from quarrymap.llm.packing import pack_documents
from quarrymap.llm.quality import keep_good
from quarrymap.llm.suffix_dedup import remove_repeats
from quarrymap.llm.toxicity import drop_toxic


#: Rows an Arrow batch: rows are whole documents, so Spark's default of 10,000 is tens of megabytes a batch.
BATCH_ROWS = 1000


def configured(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that fit documents (executors hold several at once)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network (operator 7) doesn't reject.

    Null and empty texts stay; repeated rows stay or go together; without labels of both classes all rows
    stay; an empty table gives no rows; columns of any name pass through, here and in all stages but the last.
    """
    return drop_toxic(docs, configured(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the weakly supervised verdict (operator 6).

    Null, empty and short texts go (under 20 words); repeated rows stay or go together; an empty table gives no rows.
    """
    configured(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (operator 1): the least id's, ties by the text's hash.

    Rows with a null id, and texts that are null or have no word, stay; of rows equal in id and text one stays.
    """
    configured(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 bytes or more that occur elsewhere (operator 8), with n_chars renewed.

    All rows stay, also those whose text becomes empty; null texts stay null; repeated rows lose all they share.
    """
    configured(spark)
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of what is left (operator 10; ids end with 1).

    Null and empty texts are the end id alone; repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    configured(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", packing),
]

#: Trained models, tokenizer files and suffix work can't be expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

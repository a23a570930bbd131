"""Registered queries of this package: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.ngram_join import near_duplicate_classes

    return near_duplicate_classes(read(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.bpe import round_trip_digests

    return round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.common import crc_fold
    from quarrymap.llm.langid import identify, train

    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 3) == 1)
    return identify(docs, train(docs.filter(~F.col("held_out"))), keep=["held_out"])


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.html_extract import extract_main_text

    return extract_main_text(read(spark, sf_dir, "pages"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.quality import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.common import crc_fold
    from quarrymap.llm.toxicity import score_documents, train

    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 5) == 0)
    model = train(docs.filter(~F.col("held_out")), read(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep=["held_out"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.suffix_dedup import span_digests

    return span_digests(read(spark, sf_dir, "documents"))


def op9_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the packed id matrices and returns a row per piece read back from them (documents end with <|endoftext|>, which also pads)."""
    from quarrymap.llm.token_rows import packed_rows

    return packed_rows(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=49407, pad_id=49407, pieces=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.hard_negatives import hard_negatives

    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymap.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_bpe_round_trip, op3_language_id, op4_html_extraction, op5_top_k, op6_quality_rules, op7_toxicity, op8_suffix_dedup, op9_token_rows, op10_packing, op11_whitening, op12_hard_negatives, op13_sharding)
}
ORACLES: dict[str, str] = {
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id AS id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), s AS (
            SELECT q.id AS query_id, p.id AS vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
            FROM v q JOIN v p ON q.id % 50 = 0 AND p.id <> q.id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.row AS anchor, a.id AS anchor_id, p.id, p.row, p.label = a.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v p ON a.id % 100 = 0 AND p.row <> a.row
        ), positives AS (
            SELECT anchor, anchor_id, id AS positive_id, row AS positive, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, row) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM positives JOIN s USING (anchor, anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        WINDOW w AS (PARTITION BY anchor, positive ORDER BY s.score DESC, s.id NULLS LAST, s.row)
        QUALIFY row_number() OVER w <= 5
    """,
}

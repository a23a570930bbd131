"""Re-analysis of repositories as their files arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarrymap.config import Config
from quarrymap.operators.store import save_partitioned
from quarrymap.plans.analysis import analyze
from quarrymap.schemas import RAW_FILES


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of RAW_FILES Parquet; a repository's files must land together."""
    return spark.readStream.schema(RAW_FILES).parquet(path)


def analyze_arrivals(stream: DataFrame, target: str, checkpoint: str, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Analyse every micro-batch and replace its repositories' partitions of files, edges and chunks."""

    def analyse(batch: DataFrame, _: int) -> None:
        bundle = analyze(batch, config)
        for name in ("files", "edges", "chunks"):
            save_partitioned(getattr(bundle, name), f"{target}/{name}")

    writer = stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Predictions as they arrive: each micro-batch of new files is aligned and scored once. An addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.normalize import TextConfig
from quire.operators.align import align

INCOMING = "task_id string, model string, text string, arrived timestamp"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of predictions, new files as they appear."""
    return spark.readStream.schema(INCOMING).json(folder)


def follow(spark: SparkSession, folder: str, regions: DataFrame, out: str, checkpoint: str, config: TextConfig = TextConfig()) -> StreamingQuery:
    """Writes matches of new predictions under out/batch=<id>; a batch that is done again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        align(regions, batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return incoming(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", time: str = "arrived", by: str = "model") -> DataFrame:
    """Predictions per window and model with a watermark, for streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")

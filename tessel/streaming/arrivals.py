"""An extension: feeds that arrive as files, conformed as a stream.

The batch pipeline is complete without it.  Late copies of a record are dropped
within the watermark; every micro-batch is conformed and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessel.contracts import Settings
from tessel.operators.conform import conform, specs


def conformed_stream(
    spark: SparkSession, source: str, raw_path: str, schema: str, out: str, checkpoint: str, settings: Settings | None = None, delay: str = "1 hour"
) -> StreamingQuery:
    spec = specs(settings or Settings())[source]
    rows = spark.readStream.schema(schema).parquet(raw_path).withWatermark("_ingested_at", delay).dropDuplicatesWithinWatermark(["_source", "_source_row", "_raw_payload"])

    def append(batch: DataFrame, _: int) -> None:
        kept, rejected = conform(batch, spec)
        kept.write.mode("append").parquet(f"{out}/customer")
        rejected.write.mode("append").parquet(f"{out}/_reject")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

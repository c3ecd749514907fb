"""Repeated polls of the same requests, each stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.streaming.ingest import run_available

PAYLOAD = "request_payload"
# Fixed value: the provider that keeps keyed state out of the heap.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def as_stored(requests: DataFrame) -> DataFrame:
    """A pending local request that carries the central one as JSON.

    The id is a column as well, so that the next poll need not read the JSON.
    """
    return requests.select(
        "request_id",
        F.lit("data_access").alias("request_type"),
        F.lit("pending").alias("status"),
        F.to_json(F.struct(*requests.columns)).alias(PAYLOAD),
    )


def stream_sync(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Keep each request of the polls once, as its first poll had it, in ``store``/poll=N.

    Which requests are known is keyed state of the stream (in RocksDB, on the executors):
    a poll looks up the ids it brings and reads nothing that is stored. Of several
    versions in one poll the least payload counts. A poll that is replayed writes its own folder
    again. A store belongs to one checkpoint.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    polled = as_stored(stream).withColumn("_polled", F.current_timestamp())  # one instant per poll
    known = polled.groupBy("request_id").agg(
        F.min(PAYLOAD).alias(PAYLOAD), F.min("_polled").alias("first"), F.max("_polled").alias("last")
    )

    def keep_new(batch: DataFrame, poll: int) -> None:
        new = batch.where(F.col("first") == F.col("last"))
        rows = new.select(
            "request_id", F.lit("data_access").alias("request_type"), F.lit("pending").alias("status"), PAYLOAD
        )
        rows.write.mode("overwrite").parquet(f"{store}/poll={poll}")

    run_available(known, checkpoint, keep_new, "update")

"""The log between reader and writer as a Kafka topic, for sessions that have Spark's Kafka package.

Messages are keyed by table and key, so a row's changes stand in one partition, in order of their offsets. Both ends are at least once:
merges are harmless when repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Events of a micro-batch at most, and how long it waits.
BATCH_EVENTS, WAIT = 500, "2 seconds"


def records(events: DataFrame) -> DataFrame:
    """``key, value`` in bytes of encoded events (key, value as text), as a sink of records takes them."""
    return events.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def messages(consumed: DataFrame) -> DataFrame:
    """``key, value, seq`` of consumed records (key, value, topic, partition, offset). Of one key's records the offset is the order."""
    return consumed.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))


def publish(events: DataFrame, servers: str, topic: str) -> None:
    """Write a batch of encoded events; it returns when all replicas have them."""
    records(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()


def consume(spark: SparkSession, servers: str, topic: str, batch_events: int = BATCH_EVENTS) -> DataFrame:
    """The stream of all messages from the earliest on; a micro-batch has at most ``batch_events`` of them."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return messages(stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", batch_events).load())


def republish(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """A stream of encoded events to a topic, a batch at a time."""
    return stream.writeStream.foreachBatch(lambda batch, _: publish(batch, servers, topic)).option("checkpointLocation", checkpoint).trigger(processingTime=WAIT).start()

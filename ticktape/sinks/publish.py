"""Where results go besides tables: message topics, databases fed by a stream, the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.sinks import tables


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alerts as topic records: the pair as key, so that a pair's alerts stay in order, and JSON as value."""
    return alerts.select(F.col("pair").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def publish_alerts(alerts: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of alerts to a Kafka topic.  Needs the Kafka connector on the class path."""
    writer = alert_messages(alerts).write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def stream_jdbc(
    events: DataFrame, family: S.Family, url: str, table: str, checkpoint: str, properties: dict | None = None,
    conditions: str = "keep",
) -> DataStreamWriter:
    """Append a stream of events to a database table, at least once: a repeated micro-batch appends again."""

    def write(batch: DataFrame, _: int) -> None:
        tables.write_jdbc(batch, family, url, table, properties, conditions)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def watch(df: DataFrame, rows: int = 20) -> DataStreamWriter:
    """Print a stream's rows while debugging."""
    return df.writeStream.format("console").option("numRows", rows).option("truncate", "false")

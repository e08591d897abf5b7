"""Linking of a stream of mentions: each micro-batch is a batch of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspan.functions import text
from larkspan.plans import linking


def link_stream(stream: DataFrame, kb: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Links (mention_id, text) rows as they come and appends the decisions as Parquet.

    A batch is written under its own id and replaced if it is run again, so a restart
    gives no row twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        m = df.select("mention_id", text.tokens("text").alias("terms"))
        m = m.withColumn("name", F.array_join(F.slice("terms", 1, 3), " "))
        linking.link(m, kb, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

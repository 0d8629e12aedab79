"""Fingerprints of a stream: counts, sums and XORs merge, so each batch adds a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fingerprint import VALUES, fingerprints


def append(stream: DataFrame, fields: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's fingerprints below ``path``, a folder for each batch.

    A batch that is run again after a failure replaces its own folder, so
    nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        fingerprints(batch, fields).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def total(parts: DataFrame) -> DataFrame:
    """The fingerprints of all that the stream has read."""
    return parts.groupBy("name").agg(*((F.bit_xor if v.startswith("xor") else F.sum)(v).alias(v) for v in VALUES))

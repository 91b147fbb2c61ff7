"""Incremental processing of an append-only log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.commits import SharedLog
from quillspark.sources.io import EXTRACTION


def stream_log(spark: SparkSession, folder: str, schema: str = EXTRACTION) -> DataFrame:
    """New files of JSON lines in ``folder`` as a stream; lines that don't parse are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def remaining(pairs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The pairs that a log doesn't have yet."""
    return pairs.join(done.select(*key), key, "left_anti")


def process_new(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is new since the last call, once, each batch through ``handle``; restarts go on where a run ended."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_distinct(target: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch handler that appends the rows whose key the ``SharedLog`` at ``target`` doesn't have.

    Repeated batches change nothing, and several streams may write to one log.
    """

    def handle(batch: DataFrame, _: int) -> None:
        SharedLog(batch.sparkSession, target, batch.schema, key).append(batch)

    return handle

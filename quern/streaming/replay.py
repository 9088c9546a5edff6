"""Stored tables replayed through streaming queries, whose results are tables again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.tables import shared_folder
from . import pipelines, stateful

_NAME = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful_queries(spark: SparkSession) -> Iterator[None]:
    """The state store that `stateful` needs, for the queries started within; then the one before."""
    before = spark.conf.get(_NAME)
    stateful.state_store(spark)
    try:
        yield
    finally:
        spark.conf.set(_NAME, before)


def halves(rows: DataFrame, at: str) -> list[DataFrame]:
    """Rows before the mean of a number, which is a time, and the others; a null is among these."""
    middle = rows.agg(F.avg(at)).first()[0]
    early = F.coalesce(F.col(at) < F.lit(middle), F.lit(False))
    return [rows.filter(early), rows.filter(~early)]


def replay(slices: list[DataFrame], start: Callable[[DataFrame, str], StreamingQuery], each: Callable[[int], None] | None = None) -> None:
    """Feeds slices of rows to a streaming query, one after the other.

    start: starts the query over a stream, with a checkpoint folder, so that it ends when it
    has read all that is there. It is started anew for each slice and goes on where it was:
    its state, its watermark and its place in the source come from the checkpoint. each: is
    called with the slice's number behind it.
    """
    spark = slices[0].sparkSession
    folder, checkpoint = shared_folder(spark), shared_folder(spark)
    for number, rows in enumerate(slices):
        rows.write.mode("append").parquet(folder)
        start(pipelines.source(spark, folder, slices[0].schema, 1_000_000), checkpoint).awaitTermination()
        if each is not None:
            each(number)


def appended(slices: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a query that never changes its rows (append mode) gives for the slices."""
    spark, folder, schema = slices[0].sparkSession, shared_folder(slices[0].sparkSession), None

    def start(rows: DataFrame, checkpoint: str) -> StreamingQuery:
        nonlocal schema
        out = stream(rows)
        schema = out.schema
        return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay(slices, start)
    return spark.read.schema(schema).parquet(folder)


def updated(slices: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row that a query in update mode gives for the slices, with the number of its batch."""
    spark, folder = slices[0].sparkSession, shared_folder(slices[0].sparkSession)

    def start(rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream(rows).writeStream.outputMode("update").foreachBatch(kept(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay(slices, start)
    return spark.read.parquet(folder)


def kept(folder: str) -> pipelines.Handler:
    """A handler that writes each batch to a folder; a batch that comes again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

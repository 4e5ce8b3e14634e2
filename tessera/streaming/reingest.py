"""Continuous ingest: pages that arrive as Parquet files are brought into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Embedder
from ..plans.ingest import ingest
from ..settings import Settings
from ..sources.pdf import PAGES


def follow(spark: SparkSession, folder: str, checkpoint: str, settings: Settings, embedder: Embedder, once: bool = False) -> StreamingQuery:
    """Starts the stream (once: only over what is there by now). Each file must hold whole source files, as chunk indexes count through a file.

    Ids come from content, so a batch that is run again after a failure leaves the same store.
    """
    pages = spark.readStream.schema(PAGES).parquet(folder)
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest(spark, batch, settings, embedder))
    return (writer.trigger(availableNow=True) if once else writer).start()

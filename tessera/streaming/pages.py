"""Continuous ingest page by page: a file's pages may come in any order and over any number of micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.models import Embedder
from ..operators.store import ChunkStore
from ..plans.ingest import bring_in, named, split
from ..settings import Settings

PAGES = "source_file string, page int, page_content string, metadata string"
PLACED = "source_file string, page int, chunks array<string>, metadata string, before long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageCount(StatefulProcessor):
    """Counts a file's chunks in page order. State of a file: the next page and the chunks before it, and the pages that came too early.

    A page is given out, with the number of chunks before it, as soon as all earlier ones are there; then it leaves the state. A page that
    comes again is passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "page int, before long")
        self.early = handle.getMapState("early", "page int", "chunks array<string>, metadata string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        page, before = self.at.get() if self.at.exists() else (0, 0)

        def placed(chunks: list[str], metadata: str | None) -> Row:
            nonlocal page, before
            out = Row(source_file=key[0], page=page, chunks=chunks, metadata=metadata, before=before)
            page, before = page + 1, before + len(chunks)
            return out

        for r in rows:
            if r["page"] > page:
                self.early.updateValue((r["page"],), (r["chunks"], r["metadata"]))
            elif r["page"] == page:
                yield placed(r["chunks"], r["metadata"])
                while self.early.containsKey((page,)):
                    held, own = self.early.getValue((page,)), (page,)
                    yield placed(*held)
                    self.early.removeKey(own)
        self.at.update((page, before))

    def close(self) -> None:
        pass


def placed_pages(split_: DataFrame) -> DataFrame:
    """Pages as of split(), a stream, with `before`: the chunks of the file's earlier pages."""
    return split_.select("source_file", "page", "chunks", "metadata").groupBy("source_file").transformWithState(PageCount(), PLACED, "Append", "None")


def follow_pages(spark: SparkSession, folder: str, checkpoint: str, settings: Settings, embedder: Embedder, once: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
    """Starts the stream over Parquet files of pages (source_file, page from 0 without gaps, page_content, metadata as JSON) that come into a folder.

    The store ends up with the ids of one ingest of all pages, whatever the micro-batches; a page waits in the state for those before it.
    A batch that is run again finds the same state and leaves the same store. Pages are split before they are dealt by file; those of one
    file and batch then pass through one task one by one, and the state holds only pages that came early. Runs in a session of its own,
    whose state store is RocksDB.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = own.readStream.schema(PAGES)
    pages = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)

    def take(batch: DataFrame, _: int) -> None:
        store = ChunkStore(batch.sparkSession, settings.store_path, settings.collection, buckets=settings.store_buckets)
        rows = batch.select("source_file", "page", "metadata", "before", F.posexplode("chunks").alias("pos", "chunk"))
        with store.staging() as stage:
            bring_in(batch.sparkSession, stage(named(rows.withColumn("chunk_index", (F.col("before") + F.col("pos")).cast("int")))), settings, embedder, store)

    writer = placed_pages(split(pages, settings)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()

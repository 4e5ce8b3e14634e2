"""Ingest: pages to chunks with ids, embedded by content and upserted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..operators.chunking import numbered, split_pages
from ..operators.models import Embedder, with_embeddings
from ..operators.reports import split_report
from ..operators.store import ChunkStore, VectorCache
from ..settings import Settings


def identified(pages: DataFrame, settings: Settings) -> DataFrame:
    """The chunks of pages: source_file, page, chunk_index (file-wide), id, document, metadata."""
    return named(numbered(split(pages, settings)))


def split(pages: DataFrame, settings: Settings) -> DataFrame:
    """Pages (source_file, page, page_content and perhaps metadata: a variant or JSON text) with their chunks; metadata travel as JSON."""
    metadata = F.lit(None).cast("string")
    if "metadata" in pages.columns:
        metadata = F.to_json("metadata") if dict(pages.dtypes)["metadata"] == "variant" else F.col("metadata").cast("string")
    return split_pages(pages.select("source_file", "page", "page_content", metadata.alias("metadata")), settings.chunk_size, settings.chunk_overlap)


def named(chunks: DataFrame) -> DataFrame:
    ids = chunk_id(F.col("source_file"), F.col("page"), F.col("chunk_index"), F.col("chunk"))
    return chunks.select("source_file", "page", "chunk_index", ids.alias("id"), F.col("chunk").alias("document"), "metadata")


#: Told what a step did while the ingest goes on: the step's name and its counts.
Progress = Callable[[str, dict[str, int]], None]


def quiet(step: str, counts: dict[str, int]) -> None:
    """No progress."""


def ingest(spark: SparkSession, pages: DataFrame, settings: Settings, embedder: Embedder, reset: bool = False, clean: bool = False, progress: Progress = quiet) -> DataFrame:
    """Brings the pages' chunks into the settings' collection and returns the report per file.

    Chunks that the store holds already, with this model's vectors, are passed over; of the others each text is embedded unless this model
    has embedded it before, under whatever id: a page put in front of a file moves the ids of all later chunks and costs one page. Chunks
    of an earlier state of an edited file stay unless `clean`; `reset` starts the collection anew. A failure leaves the store as it was.
    Every file is parsed and every page split once: what comes of it is staged beside the store and goes when the ingest ends. Only the
    report stays, with those of the last few ingests. `progress` is told the counts of each step as it ends; they are observed while rows
    are written, and nothing is read for them.
    """
    store, run = ChunkStore(spark, settings.store_path, settings.collection, buckets=settings.store_buckets), uuid.uuid4().hex
    with store.staging() as stage:
        parts = stage(split(pages, settings), seen := Seen("split", pages=F.count("*"), chunks=F.sum("n_chunks"), blank=F.count_if(F.col("n_chunks") == 0)))
        seen.tell(progress)
        chunks = stage(named(numbered(parts)))
        bring_in(spark, chunks, settings, embedder, store, reset, progress)
        if clean and not reset:
            store.remove_stale(chunks)
        return store.report(split_report(parts), run)


def bring_in(spark: SparkSession, chunks: DataFrame, settings: Settings, embedder: Embedder, store: ChunkStore, reset: bool = False, progress: Progress = quiet) -> None:
    """Embeds what is new among chunks (staged: read several times) and upserts it."""
    cache = VectorCache(spark, settings.store_path, settings.store_buckets)
    with store.staging() as stage:
        new = stage(chunks if reset else store.unknown(chunks, embedder.name), seen := Seen("new", chunks=F.count("*")))
        seen.tell(progress)
        texts = with_embeddings(cache.missing(new, embedder.name), embedder, "text", settings.batch_size).drop("text")
        cache.upsert(stage(texts, seen := Seen("embedded", texts=F.count("*"))))
        seen.tell(progress)
        rows = stage(cache.joined(new, embedder.name).withColumn("model", F.lit(embedder.name)).withColumn("metadata", F.parse_json("metadata")))
        version = store.reset_to(rows) if reset else store.upsert(rows)
        progress("stored", {"version": version})


class Seen:
    """Counts of rows that are observed while they are written."""

    def __init__(self, step: str, **counts: Column):
        self.step, self.counts, self.observation = step, counts, Observation(f"{step}-{uuid.uuid4().hex}")

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.observation, *(c.alias(k) for k, c in self.counts.items()))

    def tell(self, progress: Progress) -> None:
        progress(self.step, {k: v or 0 for k, v in self.observation.get.items()})

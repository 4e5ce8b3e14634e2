"""A store of embedded chunks: per collection a table in hash buckets of the ids, and the vectors of texts by their content."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key
from .buckets import BucketTable, Conflict, last_of, merged
from .models import Embedder, with_embeddings

__all__ = ["ChunkStore", "Conflict", "VectorCache", "batches", "last_of", "merged", "without_collection"]

SCHEMA = "id string, document string, source_file string, page int, chunk_index int, model string, embedding array<float>, metadata variant"


def without_collection(rows: DataFrame, collection, column: str = "collection") -> DataFrame:
    """What a reset of one collection leaves of all."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(collection)))


class ChunkStore(BucketTable):
    """The chunks of one collection, unique by id. A failure leaves the store as it was; see BucketTable for versions and writers."""

    def __init__(self, spark: SparkSession, path: str, collection: str, keep: int = 1, buckets: int = 64):
        super().__init__(spark, f"{path.rstrip('/')}/collection={collection}", SCHEMA, "id", buckets, keep)

    def snapshots(self) -> list[int]:
        return self.versions()

    def _write(self, make) -> None:
        self.write(make)

    @contextmanager
    def staging(self) -> Iterator[Callable[..., DataFrame]]:
        """Gives a function that writes rows beside the store and reads them again, so that what made them (parsing, splitting, embedding) runs
        once; `watched` may put an observation into what is written. What was staged goes when the block ends, also by an error."""
        folder = f"stage-{uuid.uuid4().hex}"
        names = (f"{self.at}/{folder}/{k}" for k in itertools.count())

        def stage(rows: DataFrame, watched: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
            at = next(names)
            (watched(rows) if watched else rows).write.parquet(at)
            return self.spark.read.schema(rows.schema).parquet(at)

        try:
            yield stage
        finally:
            self._delete(folder)

    def report(self, rows: DataFrame, run: str, last: int = 8) -> DataFrame:
        """rows kept as the report of a run; the `last` runs' reports stay."""
        number = max([0, *(int(n.split("-")[0]) for n in self._names("reports"))]) + 1
        at = f"reports/{number:010}-{run}"
        rows.write.parquet(f"{self.at}/{at}")
        for old in sorted(self._names("reports"))[:-last]:
            self._delete(f"reports/{old}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.at}/{at}")

    def unknown(self, rows: DataFrame, model: str) -> DataFrame:
        """Rows whose id the store doesn't hold with an embedding of this model: what an ingest has yet to embed. Only their buckets are read."""
        base = self.manifest()
        held = self._rows(base, self.touched(rows, base)).filter(F.col("model") == model)
        return rows.join(held.select("id"), "id", "left_anti")

    def remove_stale(self, rows: DataFrame) -> None:
        """Drops stored chunks of the source files in `rows` that aren't among `rows` (left by edited files); an option, not done on upsert."""
        files = rows.select("source_file").distinct()
        stale = self.read().select("id", "source_file").join(files, "source_file", "left_semi").join(rows.select("id"), "id", "left_anti")
        self.delete(stale.select("id"))


class VectorCache(BucketTable):
    """Embeddings by content: the key is the hash of model and text, so a text that moved within its file, or occurs in another one, keeps its vector."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, f"{path.rstrip('/')}/vectors", "content string, model string, embedding array<float>", "content", buckets, 1)

    def missing(self, rows: DataFrame, model: str, text_col: str = "document") -> DataFrame:
        """(content, model, text) once for each text of rows that has no vector of this model yet."""
        texts = rows.select(content_key(model, F.col(text_col)).alias("content"), F.lit(model).alias("model"), F.col(text_col).alias("text"))
        base = self.manifest()
        some = self.touched(texts, base) if base["files"] else []  # before texts are gathered, as it is a pass of its own
        texts = texts.groupBy("content", "model").agg(F.any_value("text").alias("text"))  # equal within a group
        return texts.join(self._rows(base, some).select("content"), "content", "left_anti") if some else texts

    def fill(self, rows: DataFrame, embedder: Embedder, text_col: str = "document") -> None:
        """Embeds the texts of rows that have no vector of this model yet. Their vectors are staged beside the table, as an upsert reads what comes in several times."""
        at = f"stage-{uuid.uuid4().hex}"
        found = with_embeddings(self.missing(rows, embedder.name, text_col), embedder, "text").drop("text")
        try:
            found.write.parquet(f"{self.at}/{at}")
            self.upsert(self.spark.read.schema(found.schema).parquet(f"{self.at}/{at}"))
        finally:
            self._delete(at)

    def joined(self, rows: DataFrame, model: str, text_col: str = "document") -> DataFrame:
        """rows with the column embedding; all their texts have to be in."""
        keyed = rows.withColumn("content", content_key(model, F.col(text_col)))
        base = self.manifest()
        return keyed.join(self._rows(base, self.touched(keyed, base)).select("content", "embedding"), "content").drop("content")


def batches(chunks: DataFrame, size: int = 64) -> DataFrame:
    """Per file and batch of `size` neighbouring chunks: first and last index and how many there are."""
    rows = chunks.withColumn("batch", F.floor(F.col("chunk_index") / size).cast("int"))
    return rows.groupBy("source_file", "batch").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("n_chunks"))

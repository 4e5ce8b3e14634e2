"""Exact nearest chunks without visiting all of them: vectors in shells around pivots, and the triangle inequality.

The chord between unit vectors, sqrt(2 * cosine distance), is a metric. Every vector belongs to its nearest pivot, and the vectors of a
pivot are cut into shells by their distance from it. A question at distance q from a pivot is at least max(q - high, low - q) from all
of a shell, so a shell where that exceeds the question's k-th distance so far can't hold an answer and isn't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import ASKED, asked_blocks, matrix, met, packed, ranked, simple

#: Pivots, the vectors of a sample that they are chosen from, vectors of a shell at most, shells whose bounds are computed at once.
PIVOTS, SAMPLE, SHELL, BOUNDS = 128, 4_096, 512, 4_096
#: What rounding may add to a chord.
SLACK = 1e-6


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which have one: zero, null and non-finite vectors don't and are zeros."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((values * values).sum(axis=1))
    valid = np.isfinite(norms) & (norms > 0)
    return np.where(valid[:, None], values / np.where(valid, norms, 1.0)[:, None], 0.0), valid


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def farthest_first(vectors: np.ndarray, most: int) -> np.ndarray:
    """Pivots from unit vectors: each the farthest from those before, until all that is left are copies."""
    chosen, away = [0], chords(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(most, len(vectors)) and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, chords(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def gathered(rows: DataFrame, most: int) -> DataFrame:
    """rows in arrays: a row for up to `most` neighbouring ones, of the same column names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in part.columns], part.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` array<{t}>" for c, t in rows.dtypes))


class PivotIndex:
    """An index in a folder that all executors share: pivots, shells (vectors and all), and what searches stage.

    Pivots come from a bounded sample (SAMPLE vectors), which decides how much is visited and no result; every vector is indexed. Vectors
    are dealt by range of (pivot, distance, hash), so neither a pivot with a third of all vectors nor a vector that many rows repeat lands
    in one task. Zero, null and non-finite vectors make shells of their own, which are read only for questions that lack k others.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def build(self, store: DataFrame, id_col: str = "id", vector_col: str = "embedding", pivots: int = PIVOTS, shell: int = SHELL) -> PivotIndex:
        rows = store.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        n = rows.count()
        share = min(1.0, SAMPLE / max(n, 1))
        sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("pivots")), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(2 * SAMPLE).toArrow()
        values, valid = units(matrix(sample.column(0).combine_chunks())) if len(sample) else (np.zeros((0, 0)), np.zeros(0, bool))
        centres = farthest_first(values[valid], pivots) if valid.any() else np.zeros((0, values.shape[1]))
        self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(centres)], "pivot int, vector array<double>").coalesce(1).write.parquet(f"{self.at}/pivots")
        shared = self.spark.sparkContext.broadcast(centres)  # PIVOTS vectors

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, ok = units(matrix(batch.column(1)))
                pivot, reach = np.full(len(own), -1, np.int32), np.zeros(len(own))
                if len(shared.value) and ok.any():
                    away = chords(own[ok], shared.value)
                    pivot[ok] = away.argmin(axis=1)
                    reach[ok] = away.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(reach)], [*batch.schema.names, "pivot", "reach"])

        placed = rows.mapInArrow(assign, f"id {simple(rows, 'id')}, vector {simple(rows, 'vector')}, pivot int, reach double")
        placed = placed.repartitionByRange("pivot", "reach", F.xxhash64("id")).sortWithinPartitions("pivot", "reach")
        shells = packed(placed, "id", "vector", shell, "pivot", "reach").withColumnRenamed("key", "pivot")
        shells.withColumn("shell", F.monotonically_increasing_id()).write.parquet(f"{self.at}/shells")
        return self

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        at = f"{self.at}/search-{uuid.uuid4().hex}/{name}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _chosen(self, questions: DataFrame, k: int | None) -> DataFrame:
        """(qid, shell, bound, n): with k, the shells of the smallest bounds that hold k rows together; else those within the questions' `most`."""
        centres = np.array([r["vector"] for r in self.spark.read.parquet(f"{self.at}/pivots").orderBy("pivot").collect()])  # PIVOTS rows
        shared = self.spark.sparkContext.broadcast(centres)
        shells = self.spark.read.parquet(f"{self.at}/shells").select("shell", "pivot", "low", "high", F.col("n").cast("long").alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    shell, pivot, low, high, n, qids, vectors, most = (batch.column(c)[i].values for c in range(8))
                    pivot, low, high, n, most = (np.asarray(x) for x in (pivot, low, high, n, most))
                    asked, valid = units(matrix(vectors))
                    bound = np.zeros((len(asked), len(pivot)))
                    if len(shared.value) and asked.shape[1] == shared.value.shape[1]:
                        away = chords(asked, shared.value)[:, pivot]
                        bound = np.maximum(np.maximum(away - high, low - away) - SLACK, 0.0)
                    bound[~valid] = 0.0
                    bound[:, pivot < 0] = np.inf
                    if k is None:
                        q, s = np.nonzero(bound <= most[:, None])
                    else:
                        order = np.argsort(bound, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        q, place = np.nonzero(before < k)
                        s = order[q, place]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), shell.take(pa.array(s)), pa.array(bound[q, s]), pa.array(n[s])], ["qid", "shell", "bound", "n"])

        pairs = gathered(shells, BOUNDS).crossJoin(gathered(questions.select("qid", "vector", "most"), ASKED))
        found = pairs.mapInArrow(run, f"qid {simple(questions, 'qid')}, shell long, bound double, n long")
        if k is None:
            return found
        order = Window.partitionBy("qid").orderBy("bound", "shell").rowsBetween(Window.unboundedPreceding, -1)
        return found.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < k).drop("before")

    def _visited(self, chosen: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """(qid, id, distance): k rows of each chosen shell and question. Questions of one shell are dealt over tasks, so that one which all ask is no bottleneck."""
        asked = chosen.select("qid", "shell").join(questions.select("qid", "vector"), "qid").withColumn("lane", F.pmod(F.xxhash64("qid"), F.lit(64)))
        asked = asked.repartition("shell", "lane").sortWithinPartitions("shell")
        shells = self.spark.read.parquet(f"{self.at}/shells")
        pairs = shells.join(asked_blocks(packed(asked, "qid", "vector", ASKED, "shell")), F.col("shell") == F.col("key"))
        return met(pairs, k, "qid", "id", simple(questions, "qid"), shells.schema["ids"].dataType.elementType.simpleString())

    def search(self, questions: DataFrame, k: int, qid_col: str = "qid", question_col: str = "vector") -> tuple[DataFrame, DataFrame]:
        """top_batch()'s rows (qid, id, distance, rank), and per question how many rows were visited (qid, rows).

        First the shells of the smallest bounds that hold k rows are read; their k-th distance then rules out all shells that are farther.
        Ties at the k-th distance are visited. A zero or null question has no distances and visits everything.
        """
        asked = questions.select(F.col(qid_col).alias("qid"), F.col(question_col).alias("vector"), F.lit(float("inf")).alias("most"))
        first = self._staged(self._chosen(asked, k), "first")
        near = self._staged(ranked(self._visited(first, asked, k), k, "qid", "id"), "near")
        kth = near.filter((F.col("rank") == k) & F.col("distance").isNotNull()).select("qid", F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("reached"))
        within = asked.drop("most").join(kth, "qid", "left").select("qid", "vector", F.coalesce(F.col("reached") + SLACK, F.lit(float("inf"))).alias("most"))
        more = self._staged(self._chosen(within, None).join(first, ["qid", "shell"], "left_anti"), "more")
        both = near.drop("rank").unionByName(self._visited(more, asked, k))
        visits = first.select("qid", "n").unionByName(more.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("rows"))
        return ranked(both, k, "qid", "id").withColumnRenamed("qid", qid_col), visits.withColumnRenamed("qid", qid_col)

    def discard(self) -> None:
        """Deletes the index and what its searches staged; results that were not read by then are lost."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Exact nearest chunks by cosine distance, for one question or for a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from .blocks import ASKED, ROWS, asked_blocks, met, packed, ranked, simple

#: Asked collections that a filter names.
FEW = 1_000
#: Slices of the distances, which go from 0 to 2, in which a question's rows are numbered where all of them are asked for.
SLICES = 4_096


def top_single(store: DataFrame, question: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of the store to one vector, with distance and rank from 1. Ties go to the smaller id; zero or null vectors come last, at null."""
    q = F.array(*(F.lit(float(x)) for x in question))
    rows = store.withColumn("distance", cosine_distance(F.col(vector_col), q)).orderBy(F.asc_nulls_last("distance"), id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), id_col)))  # k rows


def top_batch(store: DataFrame, questions: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", question_col: str = "vector", block: int = ASKED) -> DataFrame:
    """For each question its k nearest rows: qid, id, distance, rank (from 1), by the rules of top_single().

    Stored vectors and questions are packed into blocks where they are (`block` questions each), and every block of rows meets every block
    of questions in one product: one scan of the store for any number of questions. Spark sends the questions to every task where their
    table is small by its size (spark.sql.autoBroadcastJoinThreshold) and else pairs partitions with partitions. At most k rows of a
    question and task are shuffled to be ranked. Nothing runs while the plan is built.
    """
    pairs = packed(store, id_col, vector_col).crossJoin(asked_blocks(packed(questions, qid_col, question_col, block)))
    return ranked(met(pairs, k, qid_col, id_col, simple(questions, qid_col), simple(store, id_col)), k, qid_col, id_col)


def ordered(store: DataFrame, questions: DataFrame, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", question_col: str = "vector", block: int = ASKED) -> DataFrame:
    """top_batch() for a k that no store reaches: every row of the store with its rank, for each question.

    The result is as large as all pairs. A question's rows are numbered in slices of its distances, and counts of slices (a row each) give what
    comes before one, so they are never all in one task, unless they are all as far away.
    """
    pairs = packed(store, id_col, vector_col).crossJoin(asked_blocks(packed(questions, qid_col, question_col, block)))
    found = met(pairs, ROWS, qid_col, id_col, simple(questions, qid_col), simple(store, id_col))
    found = found.withColumn("_slice", F.coalesce(F.floor(F.col("distance") * (SLICES // 2)), F.lit(SLICES + 1)).cast("int"))  # null distances come last
    counts = found.groupBy(qid_col, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(qid_col).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(qid_col).alias("_of"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(qid_col, "_slice").orderBy(F.asc_nulls_last("distance"), id_col))
    out = found.withColumn("_own", own).join(starts, F.col(qid_col).eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
    return out.withColumn("rank", (F.col("_start") + F.col("_own")).cast("int")).select(qid_col, id_col, "distance", "rank")


def top_by_key(store: DataFrame, questions: DataFrame, k: int, key_col: str = "collection", id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", question_col: str = "vector", block: int = ASKED) -> DataFrame:
    """top_batch() where each question is asked of its own collection (key_col of both tables), over any number of collections.

    Rows of collections that nobody asks are left out first. Up to FEW asked collections (looked up while the plan is built) become a
    filter, so a store partitioned by key_col is read in those partitions only; more are a semi-join. Blocks meet by their key, so a
    collection of any size is many rows of the join, which splits where it is skewed. Null keys match nothing.
    """
    keys = questions.select(key_col).filter(F.col(key_col).isNotNull()).distinct()
    few = [r[0] for r in keys.limit(FEW + 1).collect()]
    rows = store.filter(F.col(key_col).isin(few)) if len(few) <= FEW else store.join(keys, key_col, "left_semi")
    rows = rows.sortWithinPartitions(key_col)
    own = packed(questions.filter(F.col(key_col).isNotNull()).sortWithinPartitions(key_col), qid_col, question_col, block, key_col)
    pairs = packed(rows, id_col, vector_col, key_col=key_col).join(asked_blocks(own), "key")
    return ranked(met(pairs, k, qid_col, id_col, simple(questions, qid_col), simple(store, id_col)), k, qid_col, id_col)

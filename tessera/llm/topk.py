"""Exact top-k by inner product over a bit-sliced index.

Attributes are quantised to integers and kept as bit slices: one bitmap over the rows for each binary digit of each attribute.
A query's scores are added up with bitmap arithmetic alone, all rows of a block at once, into slices of the total; the best rows
are then selected from the most significant slice downward, and rows that tie at the boundary are resolved exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, K, EVERY = 64, 20, 20
#: Rows of an index block and queries of a query block; a task holds one of each.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 4_096
LONG = 1 << 63


def quantise(vectors: list, scale: int = SCALE) -> list[list[int]]:
    """floor(scale * x) of each component, as whole numbers of any size."""
    return [[math.floor(scale * float(x)) for x in v] for v in vectors]


def total(columns: list[list]) -> list:
    """Slices of the sum of many bitmaps, columns[w] of weight 2 ** w: three of a weight become one of it and one of the next (carry save)."""
    out, w = [], 0
    columns = [list(c) for c in columns]
    while w < len(columns):
        here = columns[w]
        while len(here) > 1:
            if w + 1 == len(columns):
                columns.append([])
            if len(here) > 2:
                x, y, z = here.pop(), here.pop(), here.pop()
                both = x ^ y
                here.insert(0, both ^ z)
                both &= z  # a bitmap of its own; x, y and z may be the index's
                both |= x & y
                columns[w + 1].append(both)
            else:
                x, y = here.pop(), here.pop()
                here.append(x ^ y)
                columns[w + 1].append(x & y)
        out.append(here[0] if here else None)
        w += 1
    return out


@dataclass
class Index:
    """Slices over a block of rows in order of their ids. A component x is kept as x + lift (0 or more), lift being a power of 2 per attribute."""

    ids: np.ndarray
    rows: list[list[int]]
    slices: list[list]
    lifts: list[int]
    ones: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rows: list[list[int]]) -> Index:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], [rows[i] for i in order]
        n, size = len(rows), max(map(len, rows), default=0)
        words = -(-n // 64)
        ones = packed(np.ones(n, bool), words)
        slices, lifts = [], []
        for d in range(size):
            column = [r[d] if d < len(r) else 0 for r in rows]
            low, high = min(column), max(column)
            bits = max(1, max(high, -low - 1, 0).bit_length() + 1)
            lift = 1 << (bits - 1) if low < 0 else 0
            own = []
            if bits < 62:
                values = np.array(column, np.int64) + lift
                own = [packed((values >> b & 1).astype(bool), words) for b in range(bits)]
            else:
                own = [packed(np.fromiter(((x + lift) >> b & 1 for x in column), bool, n), words) for b in range(bits)]
            slices.append([s if s.any() else None for s in own])
            lifts.append(lift)
        return cls(ids, rows, slices, lifts, ones)

    def scores(self, query: list[int]) -> list:
        """Slices of (score + a number that is the same for all rows), never negative.

        sum q x = sum over q > 0 of q x + sum over q < 0 of |q| (-x). With y = x + lift from 0 to 2 lift - 1, q x is q y less a
        constant, and -y is the complement of y's slices less a constant; so every term adds bitmaps of positive weight.
        """
        columns: list[list] = []
        for d, q in enumerate(query[: len(self.slices)]):
            own = self.slices[d]
            if q < 0:
                own = [self.ones if s is None else s ^ self.ones for s in own]
            m = abs(q)
            for i in range(m.bit_length()):
                if m >> i & 1:
                    for j, s in enumerate(own):
                        if s is not None:
                            while len(columns) <= i + j:
                                columns.append([])
                            columns[i + j].append(s)
        return total(columns)

    def top(self, query: list[int], own_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k highest scores without the row own_id, ties to smaller ids."""
        slices = self.scores(query)
        tied = self.ones
        own = np.searchsorted(self.ids, own_id)
        if own < len(self.ids) and self.ids[own] == own_id:
            tied = tied.copy()
            tied[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure, n_sure = np.zeros_like(tied), 0
        for s in reversed(slices):
            if n_sure == k:
                break
            if s is None:
                continue
            up = tied & s
            n = int(np.bitwise_count(up).sum())
            if n_sure + n <= k:
                sure, n_sure = sure | up, n_sure + n
                tied = tied & ~s
            else:
                tied = up
        at = [*places(sure), *places(tied)[: k - n_sure]]
        return [(int(self.ids[i]), inner(query, self.rows[i])) for i in at]


def inner(a: list[int], b: list[int]) -> int:
    """Inner product of whole numbers; the shorter vector counts as 0 beyond its end. Kept within the range of a long."""
    return min(LONG - 1, max(-LONG, sum(x * y for x, y in zip(a, b, strict=False))))


def packed(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    own = np.packbits(bits, bitorder="little")
    out[: len(own)] = own
    return out.view(np.uint64)


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) that take part: an id, and a vector without null, NaN or infinite components. Of a repeated id the smallest vector counts."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of queries its k best rows of vectors, its own id left out: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * x). Every row of vectors is indexed and every query meets every block, so results are exact;
    ties go to smaller ids; fewer rows than k: all of them; an empty side: an empty result. Vectors that are null or hold null or
    non-finite components take no part on either side, an empty vector scores 0; other columns are not read. Each task has one
    block of rows and one of queries and gives at most k rows a query, which are ranked at the end.
    """
    rows = common.settled(usable(vectors, id_col, vector_col))
    asked = common.settled(usable(queries, id_col, vector_col))
    n_rows, n_queries = rows.count(), asked.count()
    # at least as many pairs of blocks as there are tasks to give out, while blocks stay of a size worth the slicing
    blocks = max(1, math.ceil(n_rows / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    while blocks * query_blocks < rows.sparkSession.sparkContext.defaultParallelism and n_queries / query_blocks > 128:
        query_blocks += 1
    every_q = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    every_b = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), every_q.alias("q"), F.lit(0).alias("side"), "id", "v")
    right = asked.select(every_b.alias("b"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"), F.lit(1).alias("side"), "id", "v")
    grid = left.unionByName(right).withColumn("cell", F.col("b") * query_blocks + F.col("q"))
    grid = grid.repartitionById(blocks * query_blocks, F.col("cell")).select("side", "id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {0: ([], []), 1: ([], [])}
        for batch in batches:
            for side, (ids, vs) in held.items():
                of = batch[batch["side"] == side]
                ids.extend(of["id"].tolist())
                vs.extend(quantise(of["v"].tolist(), scale))
        if not held[0][0] or not held[1][0]:
            return
        index = Index.of(np.array(held[0][0], np.int64), held[0][1])
        found = [(q, *pair) for q, v in zip(*held[1], strict=True) for pair in index.top(v, q, k)]
        yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = grid.mapInPandas(run, "query_id long, vec_id long, score long")
    order = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    ranked = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("top"))  # k rows a block
    out = ranked.select("query_id", F.posexplode("top").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_bit_sliced_topk(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Vectors in blocks: a row holds many vectors as one matrix, so that two tables of vectors meet as a few large products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a block holds at most, of the stored rows and of the questions.
ROWS, ASKED = 2_048, 512
#: Rows of answers that leave a task at once.
OUT = 1 << 16

BLOCK = "ids array<{}>, vectors binary, dim int, n int"


def matrix(vectors: pa.Array) -> np.ndarray:
    """An array of lists as a matrix of doubles; a null list is a row of zeros, a null number NaN. All lists are of one length."""
    lengths = set(pc.unique(pc.list_value_length(vectors)).to_pylist()) - {None}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    out = np.zeros((len(vectors), max(lengths, default=0)))
    there = np.asarray(vectors.is_valid())
    out[there] = np.asarray(vectors.flatten().fill_null(np.nan), float).reshape(out[there].shape)
    return out


def packed(rows: DataFrame, id_col: str, vector_col: str, most: int = ROWS, key_col: str | None = None, reach_col: str | None = None) -> DataFrame:
    """rows (id, vector) in blocks: ids, vectors (doubles), dim, n; each block in the order of the ids, so that a place stands for an id where distances tie.

    Blocks are made where the rows are, from neighbouring ones. With key_col, rows sorted by it within their partitions make blocks of one
    key (column `key`); with reach_col, blocks also have the smallest and largest reach (low, high).
    """
    columns = [id_col, vector_col, *([key_col] if key_col else []), *([reach_col] if reach_col else [])]
    schema = BLOCK.format(rows.schema[id_col].dataType.simpleString())
    schema += f", key {rows.schema[key_col].dataType.simpleString()}" if key_col else ""
    schema += ", low double, high double" if reach_col else ""

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.take(pc.sort_indices(part.column(0).combine_chunks()))
        ids, values = part.column(0).combine_chunks(), matrix(part.column(1).combine_chunks())
        out = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([values.tobytes()], pa.binary()), pa.array([values.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32())]
        names = ["ids", "vectors", "dim", "n"]
        if key_col:
            out, names = [*out, part.column(2).combine_chunks().slice(0, 1)], [*names, "key"]
        if reach_col:
            reach = pc.min_max(part.column(len(columns) - 1))
            out, names = [*out, pa.array([reach["min"].as_py()], pa.float64()), pa.array([reach["max"].as_py()], pa.float64())], [*names, "low", "high"]
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) > most or (key_col and len(held) and held.column(2)[0] != held.column(2)[-1]):
                n = min(most, len(held))
                if key_col:
                    own = pc.fill_null(pc.equal(held.column(2), held.column(2)[0]), False) if held.column(2)[0].is_valid else pc.is_null(held.column(2))
                    ends = pc.index(own, False).as_py()
                    n = n if ends < 0 else min(n, ends)
                yield block(held.slice(0, n))
                held = held.slice(n)
        if held is not None and len(held):
            yield block(held)

    return rows.select(*columns).mapInArrow(run, schema)


def nearest(ids: pa.Array, values: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, question, cosine distance) of the k nearest rows (in the order of their ids) to each question; inf where there is no distance."""
    with np.errstate(all="ignore"):
        d = 1.0 - (values @ asked.T) / np.outer(np.sqrt((values * values).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1)))
    d[~np.isfinite(d)] = np.inf
    n = min(k, len(ids))
    at, q = np.nonzero(d <= np.partition(d, n - 1, axis=0)[n - 1])
    best = np.lexsort((at, d[at, q], q))
    at, q = at[best], q[best]
    near = np.arange(len(q)) - np.searchsorted(q, q) < n  # places among a question's rows
    at, q = at[near], q[near]
    return at, q, d[at, q]


def met(pairs: DataFrame, k: int, qid_col: str, id_col: str, qid_type: str, id_type: str) -> DataFrame:
    """Pairs of blocks (ids, vectors, dim and the questions' q_ids, q_vectors, q_dim) as (qid, id, distance): of each pair k rows a question. Null distances are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, raw, dim, qids, q_raw, q_dim = (batch.column(c)[i] for c in range(6))
                ids, qids = ids.values, qids.values
                if dim.as_py() and q_dim.as_py() and dim.as_py() != q_dim.as_py():
                    raise ValueError(f"vectors of different lengths: {dim.as_py()} and {q_dim.as_py()}")
                size = max(dim.as_py(), q_dim.as_py())
                values, asked = (np.frombuffer(x.as_buffer()).reshape(n, d) if d else np.zeros((n, size)) for x, n, d in ((raw, len(ids), dim.as_py()), (q_raw, len(qids), q_dim.as_py())))
                at, q, d = nearest(ids, values, asked, k)
                for low in range(0, len(q), OUT):
                    s = slice(low, low + OUT)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[s])), ids.take(pa.array(at[s])), pa.array(d[s], mask=np.isinf(d[s]))], [qid_col, id_col, "distance"])

    found = pairs.select("ids", "vectors", "dim", "q_ids", "q_vectors", "q_dim")
    return found.mapInArrow(run, f"`{qid_col}` {qid_type}, `{id_col}` {id_type}, distance double")


def asked_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of questions under the names that met() reads."""
    return blocks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "dim": "q_dim", "n": "q_n"})


def ranked(found: DataFrame, k: int, qid_col: str, id_col: str) -> DataFrame:
    """Of rows (qid, id, distance) the k nearest of each question with their rank from 1; k a question and task at most are shuffled."""
    order = Window.partitionBy(qid_col).orderBy(F.asc_nulls_last("distance"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def simple(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()

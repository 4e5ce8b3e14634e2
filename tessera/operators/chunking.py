"""Splitting pages into overlapping chunks at the largest separators that make them small enough."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.ranking import WIDTH, running

#: Tried in this order, fixed values: blank line, line end, blank, every character.
SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of chunks after which a task gives out what it has, and the most rows of one batch.
GIVEN_CHARS, GIVEN_ROWS = 1 << 21, 4_096


def pieces(text: str, separator: str) -> list[str]:
    """text cut so that every piece but the first begins with the separator; no empty pieces."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def merge(parts: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined up to `size` characters; each chunk takes over whole pieces of at most `overlap` characters from the one before."""
    held: deque[str] = deque()
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            if chunk := "".join(held).strip():
                yield chunk
            while total > overlap or (total > 0 and total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    if chunk := "".join(held).strip():
        yield chunk


def split_text(text: str | None, size: int = 1200, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> Iterator[str]:
    """The chunks of one page, lengths in code points, without white space at their ends; none for a null or blank page.

    The first separator that occurs cuts the page; runs of pieces shorter than `size` are merged, a longer piece is split by the
    separators that remain and shares no overlap with its neighbours. A piece that nothing can split stays whole.
    """
    if not text:
        return
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    short: list[str] = []
    for piece in pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        yield from merge(short, size, overlap)
        short = []
        if rest:
            yield from split_text(piece, size, overlap, rest)
        else:
            yield piece
    yield from merge(short, size, overlap)


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 200, text_col: str = "page_content") -> DataFrame:
    """A row per chunk: the page's other columns, pos (0-based within the page) and chunk. A page never shares a chunk with another.

    A page's other columns come once for each of its chunks: what is as long as the page itself belongs into split_pages().
    """
    keep = [c for c in pages.columns if c != text_col]
    rows = pages.select(F.col(text_col).cast("string").alias("_split_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(batch: pa.RecordBatch, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            at, pos, out = zip(*rows, strict=True)
            places = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(places) for c in batch.columns[1:]), pa.array(pos, pa.int32()), pa.array(out, pa.string())], [*keep, "pos", "chunk"])

        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column(0)):
                for k, chunk in enumerate(split_text(text.as_py(), size, overlap)):
                    rows.append((i, k, chunk))
                    held += len(chunk)
                    if held >= GIVEN_CHARS or len(rows) >= GIVEN_ROWS:
                        yield given(batch, rows)
                        rows, held = [], 0
            if rows:
                yield given(batch, rows)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, pos int, chunk string")


def split_pages(pages: DataFrame, size: int = 1200, overlap: int = 200, text_col: str = "page_content") -> DataFrame:
    """A row per page: its other columns, chunks (an array, empty for a blank page) and n_chunks."""
    keep = [c for c in pages.columns if c != text_col]
    rows = pages.select(F.col(text_col).cast("string").alias("_split_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(batch: pa.RecordBatch, found: list[list[str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.string())), pa.array(map(len, found), pa.int32())], [*keep, "chunks", "n_chunks"])

        for batch in batches:
            first, found, held = 0, [], 0
            for i, text in enumerate(batch.column(0)):
                found.append(list(split_text(text.as_py(), size, overlap)))
                held += sum(map(len, found[-1]))
                if held >= GIVEN_CHARS or len(found) >= GIVEN_ROWS:
                    yield given(batch.slice(first, len(found)), found)
                    first, found, held = i + 1, [], 0
            if found:
                yield given(batch.slice(first), found)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, chunks array<string>, n_chunks int")


def numbered(split: DataFrame, file_col: str = "source_file", page_col: str = "page") -> DataFrame:
    """A row per chunk of split_pages()'s rows: the page's columns, pos, chunk, chunk_index (from 0 over all pages of a file, in page order).

    Pages are shuffled once, by file and range of WIDTH page numbers, and that one exchange serves both the sums of the ranges and the pages
    themselves, so nothing above it is computed twice. No file is ever whole in one task. Page numbers do not repeat within a file; a null
    file is a file like any other.
    """
    file = F.coalesce(F.concat(F.lit("="), F.col(file_col)), F.lit(""))
    rows = split.drop("n_chunks").withColumn("_file", file).withColumn("_range", F.coalesce(F.floor(F.col(page_col) / WIDTH), F.lit(0))).repartition("_file", "_range")
    n = F.size("chunks")
    # the sums read every column that the pages need, or Spark would prune theirs and shuffle anew
    others = [c for c in split.columns if c not in ("chunks", "n_chunks")]
    sums = rows.groupBy("_file", "_range").agg(F.sum(n).alias("_sum"), F.max(F.hash(*others)).alias("_read"))
    earlier = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_file").alias("_of"), F.col("_range").alias("_at"), "_read", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file", "_range").orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    out = placed.join(starts, (placed["_file"] == starts["_of"]) & (placed["_range"] == starts["_at"]) & starts["_read"].isNotNull())
    out = out.select(*others, F.posexplode("chunks").alias("pos", "chunk"), (F.col("_start") + F.col("_inside")).alias("_before"))
    return out.withColumn("chunk_index", (F.col("_before") + F.col("pos")).cast("int")).drop("_before")


def indexed(chunks: DataFrame, file_col: str = "source_file", page_col: str = "page") -> DataFrame:
    """chunks with chunk_index, counted from 0 over all pages of a file in page order: what earlier pages have, plus pos."""
    pages = chunks.groupBy(file_col, page_col).agg(F.count("*").alias("_n"))
    before = running(pages, file_col, page_col, "_n", "_before").select(F.col(file_col).alias("_file"), F.col(page_col).alias("_page"), "_before")
    out = chunks.join(before, chunks[file_col].eqNullSafe(before["_file"]) & chunks[page_col].eqNullSafe(before["_page"]))
    return out.withColumn("chunk_index", (F.col("_before") + F.col("pos")).cast("int")).drop("_file", "_page", "_before")


@udtf(returnType="pos int, chunk string")
class SplitText:
    """The splitter as a table function: SELECT ... FROM pages, LATERAL split_text(page_content, 1200, 200)."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(split_text(text, size, overlap))


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_text", SplitText)

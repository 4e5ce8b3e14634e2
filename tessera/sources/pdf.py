"""PDF files as pages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import base_name

PAGES = "source_file string, page int, page_content string"


class NoSource(RuntimeError):
    """A source without a single file."""


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the folder's own *.pdf files (case counts; hidden names and those that begin with _ are passed over)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def require_files(files: DataFrame, folder: str) -> DataFrame:
    if files.select("path").isEmpty():
        raise NoSource(f"{folder} holds no *.pdf file")
    return files


def pdf_pages(files: DataFrame) -> DataFrame:
    """A row per page, also for a blank one: source_file (base name), page (from 0), page_content. Needs the optional package pypdf."""
    rows = files.select(base_name(files["path"]).alias("source_file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pypdf import PdfReader

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for page, p in enumerate(PdfReader(io.BytesIO(content.as_py())).pages):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([page], pa.int32()), pa.array([p.extract_text() or ""])], ["source_file", "page", "page_content"])

    return rows.mapInArrow(run, PAGES)

"""Tables of texts as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(docs: DataFrame, file_col: str = "source", order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A text per row as a page: its file, its 0-based place among the file's rows, its content."""
    rows = docs.select(F.col(file_col).alias("source_file"), F.col(order_col).alias("_order"), F.col(text_col).alias("page_content"))
    return positions(rows, "source_file", "_order", "page").select("source_file", F.col("page").cast("int").alias("page"), "page_content")

"""What an ingest did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per file the pages (blank ones count) and chunks, 0 where a file gave none."""
    files = pages.groupBy("source_file").agg(F.count("*").alias("pages"))
    counts = chunks.groupBy(F.col("source_file").alias("_file")).agg(F.count("*").alias("_chunks"))
    out = files.join(counts, files["source_file"].eqNullSafe(counts["_file"]), "left")
    return out.select("source_file", "pages", F.coalesce("_chunks", F.lit(0)).cast("long").alias("chunks"))


def split_report(split: DataFrame) -> DataFrame:
    """ingest_report() from pages that are split already (source_file, n_chunks): one aggregation of two narrow columns."""
    return split.groupBy("source_file").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"))


def ingest_total(report: DataFrame) -> DataFrame:
    """One row: files, pages, chunks."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return report.agg(F.count("*").alias("files"), total("pages"), total("chunks"))

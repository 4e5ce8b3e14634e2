"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 16


def score(key: Column, shard: int, weight: float) -> Column:
    """How strongly a key is drawn to a shard: -weight / ln(u), u uniform in (0, 1) from a hash of the key and the shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) that draws the key most; equal scores go to the smaller shard.

    A shard of weight 0 gets nothing. A further shard takes keys only into itself, about its share of the weights, since the
    other scores stay as they are. A null key is a key like any other.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one of them above 0")
    rated = [F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*rated))["i"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (null text: 1, crc32 of no bytes). The law is `key`: only the id and the weights
    decide. slot numbers a shard's rows from 0 without a gap. grown_shard is the shard under `grown` weights (one more shard of
    the mean weight by default). Repeated rows are rows of their own and share a shard; an empty table gives an empty result;
    other columns are not read.
    """
    grown = [*weights, sum(weights) / len(weights)] if grown is None else grown
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = common.id_text(id_col)
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
    )
    out = common.numbered(common.settled(rows), "shard", "slot")
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))

"""Pieces that several operators share: reading, materialising, splitting by id, blocks of long texts, gapless numbers."""

from __future__ import annotations

import atexit
import itertools
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A text is worked on in pieces of about so many characters, so that memory doesn't follow the longest text.
BLOCK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or what was set as its checkpoint folder.

    Where neither is set, a folder of our own on one machine, which goes when Python ends; on a cluster an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return at or sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and cut from its lineage; its rows keep their partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_text(column: str = "doc_id") -> Column:
    """The id as text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.crc32(id_text(column)) % 5 == 0


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows whose hashed key falls under most / count: about `most` rows at any size, all rows up to there, the same ones every time."""
    n = rows.count()
    if n <= most:
        return rows
    cut = int(most / n * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < cut)


def blocks(text: str, size: int = BLOCK_CHARS, space: Callable[[str], bool] = str.isspace) -> Iterator[str]:
    """text in pieces of about `size` characters that end where white space begins; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not space(text[end]):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text) or not at:
        yield text[at:]


def numbered(df: DataFrame, key: str, name: str, chunk: int = 65_536, least: int = 16) -> DataFrame:
    """df (settled) with the column `name`: a gapless number from 0 within each value of `key`, a small non-null integer.

    No group of rows is ever whole in one task, however many rows share a key: each key is dealt into buckets of about
    `chunk` rows by a hash of the row's place, buckets are numbered on their own, and what comes before a bucket is added
    from the bucket counts (one row per key and bucket).
    """
    n = df.count()
    deal = max(least, math.ceil(n / chunk))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(deal)).cast("int"))
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_bucket").orderBy("_row")
    out = rows.withColumn("_own", F.row_number().over(own) - 1).join(starts, [key, "_bucket"])
    return out.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_row", "_bucket", "_own", "_start")


#: Keys that hold more than this share of all rows are joined by sending their few rows to every task: at most 1 / HOT_SHARE keys.
HOT_SHARE = 1 / 4096


def join_with_hot_keys(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """rows (settled) joined to `side` (settled), which has every key of rows once, with the number of rows that have it.

    The rows of a hot key stay where they are and the key's row comes to them; since hot keys hold more than HOT_SHARE of all rows
    each, there are at most 1 / HOT_SHARE of them at any size. All other keys are joined by a shuffle.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total * HOT_SHARE
    few = F.broadcast(side.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(side.filter(~hot), key))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as compressed Parquet and read again: less disk than settled(), without the rows' partitions and order."""
    at = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def folder(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a stored() whose files go when the block ends."""
    at = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    names = itertools.count()

    def put(df: DataFrame) -> DataFrame:
        path = f"{at}/{next(names)}"
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        discard(spark, at)


def discard(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared one; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Classes of keys by which rows of no use are kept from moving: a bound on what is sent to every task.
SIEVE = 1 << 22


def spare(rows: DataFrame, name: str) -> str:
    """name, or what it takes to be none of the rows' own columns (case doesn't count)."""
    own = {c.lower() for c in rows.columns}
    while name.lower() in own:
        name += "_"
    return name


def placed(docs: DataFrame, column: str = "text") -> tuple[DataFrame, str]:
    """docs with its columns named by their places (toDF() gives them back), so that none has a name of ours; and the new name of `column`."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(column)]


def kind_of(key: str) -> Column:
    """The class of a key, of SIEVE."""
    return F.pmod(F.xxhash64(key), F.lit(SIEVE)).cast("int")


def sieved(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in `some` (settled; its only column), and few others: those in a class of one of `some`. Nothing moves."""
    kind = spare(rows, "_class")
    sieve = F.broadcast(some.select(kind_of(key).alias(kind)).distinct())
    return rows.withColumn(kind, kind_of(key)).join(sieve, kind, "left_semi").drop(kind)


def parted(rows: DataFrame, some: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in `some` (settled; its only column), and the others. Of rows only those move whose key is in a class of one of `some`."""
    kind = spare(rows, "_class")
    sieve = F.broadcast(some.select(kind_of(key).alias(kind)).distinct())
    maybe, never = sieved(rows, some, key), rows.withColumn(kind, kind_of(key)).join(sieve, kind, "left_anti").drop(kind)
    return maybe.join(some, key, "left_semi").select(*rows.columns), never.unionByName(maybe.join(some, key, "left_anti")).select(*rows.columns)

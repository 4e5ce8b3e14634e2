"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

Texts are brought to one form (Unicode NFKC, full case folding, white space runs to one space), digested by two seeded passes of
xxhash64 to 128 bits, and grouped by that; inside a bucket of equal digests the canonical bytes themselves are compared, so two
texts share a fingerprint only if their canonical forms are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What counts as white space: Unicode's White_Space property and the four separators U+001C to U+001F.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: Classes of digests by which texts without a double are kept from moving: a bound on what is sent to every task (16 MB).
SIEVE = 1 << 20

#: Stands for a null id.
NO_ID = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, case folded and normalised once more (folding can undo it), white space runs one space, none at the ends; null: empty.

    Spark has no function for the normal forms; `reflect` is the SQL function that calls a static method of a class that Spark
    brings along, here ICU's.
    """
    compose, fold = F.lit("com.ibm.icu.text.Normalizer"), F.lit("com.ibm.icu.lang.UCharacter")
    whole = F.coalesce(text, F.lit(""))
    once = F.reflect(compose, F.lit("compose"), whole, F.lit(True))
    folded = F.reflect(fold, F.lit("foldCase"), once, F.lit(True))
    again = F.reflect(compose, F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, SPACE, " "))


def wide_digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: two passes of xxhash64, the second over what the first gave and the text."""
    first = F.xxhash64(canon)
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(F.xxhash64(first, canon)), 16, "0")))


def collisions(canons: DataFrame) -> DataFrame:
    """Of rows (digest, canon): a row (digest, canon, nth) for each further text of a digest that several different texts share.

    The byte comparison: rows of one digest are told apart by their whole canonical text. Each task leaves out its own copies before the
    shuffle, so a text with very many copies is one row a task.
    """
    texts = canons.select("digest", "canon").distinct()
    shared = texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    order = Window.partitionBy("digest").orderBy("canon")
    return texts.join(shared, "digest", "left_semi").withColumn("nth", F.row_number().over(order) - 1).filter("nth > 0")


def named(digest: Column, nth: Column) -> Column:
    """The fingerprint: the digest, and for the further texts of a shared digest which one."""
    return F.when(nth > 0, F.concat(digest, F.lit("-"), nth.cast("string"))).otherwise(digest)


def digests(docs: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Columns `keep`, canon and digest of every row."""
    rows = docs.select(*keep, canonical(F.col(text_col).cast("string")).alias("canon"))
    return rows.withColumn("digest", wide_digest(F.col("canon")))


def further_texts(docs: DataFrame, prints: DataFrame, text_col: str) -> DataFrame | None:
    """collisions() among the documents, settled, or None where no two texts share a digest, which is as good as always.

    Only texts whose digest occurs more than once can share it, so only those, and the few that fall into the same of SIEVE classes as one
    of them, are moved; the classes that matter are at most SIEVE numbers, which every task gets.
    """
    repeated = prints.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    sieve = repeated.select(sieved(F.col("digest")).alias("_class")).distinct()
    rows = digests(docs, text_col).withColumn("_class", sieved(F.col("digest")))
    found = common.settled(collisions(rows.join(F.broadcast(sieve), "_class", "left_semi")))
    return found if found.head(1) else None


def sieved(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(SIEVE)).cast("int")


def resolved(rows: DataFrame, further: DataFrame | None, canon: str, digest: str, name: str) -> DataFrame:
    """rows with `name`, the fingerprint of the text in column `canon`."""
    if further is None:
        return rows.withColumn(name, F.col(digest))
    own = further.select(F.col("digest").alias("_d"), F.col("canon").alias("_c"), F.col("nth").alias("_n"))
    out = rows.join(own, (rows[digest] == own["_d"]) & (rows[canon] == own["_c"]), "left")
    return out.withColumn(name, named(F.col(digest), F.col("_n"))).drop("_d", "_c", "_n")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and fingerprint. Null, empty and blank texts share one; texts of one canonical form share theirs.

    Repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    prints = common.settled(digests(docs, text_col, (F.col(id_col),)).select(id_col, "digest"))
    further = further_texts(docs, prints, text_col)
    if further is None:
        return prints.select(id_col, F.col("digest").alias("fingerprint"))
    return resolved(digests(docs, text_col, (F.col(id_col),)), further, "canon", "digest", "fingerprint").select(id_col, "fingerprint")


def neighbours(ids: DataFrame) -> DataFrame:
    """Of distinct keys (column key): each with next_key, the next lower one; the lowest goes on with the highest.

    Keys are dealt out by range, ordered inside each range, and the ranges' highest keys (one row a range) tie them together.
    """
    ranged = common.settled(ids.repartitionByRange(F.desc("key")).withColumn("_range", F.spark_partition_id()))
    heads = ranged.groupBy("_range").agg(F.max("key").alias("_head"))
    rest = Window.orderBy("_range")
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(rest), F.first("_head").over(rest)).alias("_then"))
    inside = F.lead("key").over(Window.partitionBy("_range").orderBy(F.desc("key")))
    return ranged.withColumn("_inside", inside).join(heads, "_range").withColumn("next_key", F.coalesce("_inside", "_then")).drop("_range", "_inside", "_then")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the fingerprints stand an edit: a row per document with id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, in descending order of the integer id; after the last comes the first. An exact digest is like another (1.0) or not (0.0).
    A null text counts as empty, a null id as the smallest. Rows that share an id have the same next document, and of theirs the one with
    the smallest digest is the next of others. One shuffle carries the whole texts, one the beginnings that move to their neighbour.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(key.alias("key"), text.alias("text"))  # both joins below read just these, so that one exchange serves them
    prints = common.settled(digests(texts, "text", (F.col("key"), F.length("text").cast("long").alias("n"))).select("key", "n", "digest"))
    further = further_texts(texts, prints, "text")
    ids = prints.groupBy("key").agg(F.max("n").alias("n"), F.min("digest").alias("digest"))
    # for every key: the key before it, which takes a beginning of its text, how much of it, and the digest that stands for the key
    ring = neighbours(ids)
    takers = ring.select(F.col("next_key").alias("key"), F.col("key").alias("taker"), F.floor(F.col("n") / 2).cast("int").alias("k"))
    takers = takers.join(ids.select("key", F.col("digest").alias("stands")), "key")
    given = resolved(digests(texts.join(takers, "key").select("taker", "k", "stands", "text"), "text", (F.col("taker"), F.col("stands"), F.expr("substring(text, 1, k)").alias("start"))), further, "canon", "digest", "next_fingerprint")
    given = given.filter(F.col("digest") == F.col("stands")).groupBy("taker").agg(F.min(F.struct("start", "next_fingerprint")).alias("next"))
    rows = texts.join(given, texts["key"] == given["taker"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.start", F.lit(1), half))
    rows = rows.select(F.nullif("key", F.lit(NO_ID)).cast(kind).alias("id"), n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.next_fingerprint").alias("next_fingerprint"), "text")
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.select("*", wide_digest(F.col("canon")).alias("digest"), wide_digest(F.col("edited_canon")).alias("edited_digest"))
    rows = resolved(resolved(rows, further, "canon", "digest", "fingerprint"), further, "edited_canon", "edited_digest", "edited_fingerprint")
    same = (F.col("digest") == F.col("edited_digest")) & (F.col("canon") == F.col("edited_canon"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        same.cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )


def op9_canonical_digest(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.table(spark, sf_dir, "documents"))

"""Lines that many documents repeat: each stays in one document only.

An index of line hashes grows batch by batch as a set of sorted runs: Parquet tables bucketed and sorted by the hash, so that runs meet each
other and a new batch without being shuffled again. A batch's lines are merge-anti-joined to the runs; those whose fate the runs have sealed
already add nothing, the others become a run of level 0. Runs of one level are merged into one of the next whenever there are FANOUT of them.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a table is taken in, greatest ids first; runs of a level that are merged into one of the next.
BATCHES, FANOUT = 6, 3
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends and with A-Z as a-z."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_ = F.octet_length(bare) == F.length(bare)  # there lower() does the same, and faster
    return F.when(ascii_, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """The long lines of a text, an array of (pos, line): place from 0 and the key's MD5."""
    long_ = lambda x: F.length(F.btrim(x["text"], F.lit(SPACE))) >= least_chars
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text")))
    return F.transform(F.filter(placed, long_), lambda x: F.struct(x["pos"].alias("pos"), F.md5(line_key(x["text"])).alias("line")))


class LineRuns:
    """Sorted runs of (line, docs, last): a line's hash, documents that hold it, the greatest id among them.

    Runs are tables of the session's catalogue with their files under `at`, a folder that all executors share. A line that a run has
    settled (it counts `settled` documents there, the greatest id not below a batch's) gains nothing from the batch and isn't added again:
    its docs is then a lower bound that is at least `settled`. close() drops tables and files.
    """

    def __init__(self, spark: SparkSession, at: str, settled: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.at, self.settled, self.fanout = spark, at, settled, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that a shuffled batch fits the runs
        self.levels: list[list[str]] = []

    def merged(self, names: list[str]) -> DataFrame:
        """Runs as one, a row per line. Their files are read as plain Parquet and shuffled: over a union of bucketed tables Spark 4.1.2 leaves
        the shuffle out, and reads buckets out of step."""
        rows = self.spark.read.schema("line string, docs long, last long")
        found = rows.parquet(*(f"{self.at}/{name}" for name in names)) if names else self.spark.createDataFrame([], "line string, docs long, last long")
        return found.groupBy("line").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Takes in a batch (line, doc_id), a row per line and document. It is shuffled once; the runs lie as it then does."""
        new = batch.groupBy("line").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        for name in self.names():
            known = self.spark.table(name).filter(F.col("docs") >= self.settled).select(F.col("line").alias("known"), F.col("last").alias("upto")).hint("merge")
            new = new.join(known, (F.col("line") == F.col("known")) & (F.col("last").isNull() | (F.col("upto") >= F.col("last"))), "left_anti")
        self._put(0, new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._put(level + 1, self.merged(old))
            self.levels[level] = []
            self._drop(old)
            level += 1

    def _put(self, level: int, rows: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "line").sortBy("line").option("compression", "zstd").option("path", f"{self.at}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            common.discard(self.spark, f"{self.at}/{name}")

    def close(self) -> None:
        self._drop(self.names())
        self.levels = []
        common.discard(self.spark, self.at)


def repeated_lines(held: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(line, last) for the lines that least_docs or more documents hold. held (stored): doc_id and lines as of lines_of().

    The batches are ranges of ids, the greatest first: the first document that brings a line is then the one that keeps it, and whatever
    comes after a line is settled needs no more room. Every line of every document is counted or known to be settled.
    """
    spark = held.sparkSession
    shares = [k / batches for k in range(1, batches)]
    cuts = held.agg(F.percentile_approx("doc_id", shares, 1_000)).first()[0] if shares else None  # null where all ids are
    cuts = sorted(set(cuts or ()), reverse=True)
    runs = LineRuns(spark, f"{common.shared_dir(spark)}/lines-{uuid.uuid4().hex}", least_docs, fanout)
    above = F.lit(False)
    for cut in [*cuts, None]:
        here = F.lit(True) if cut is None else F.coalesce(F.col("doc_id") > cut, F.lit(False))
        batch = held.filter(here & ~above)
        runs.add(batch.select("doc_id", F.explode(F.array_distinct(F.col("lines.line"))).alias("line")))
        above = here
    found = common.stored(runs.merged(runs.names()).filter(F.col("docs") >= least_docs).select("line", "last"))
    runs.close()
    return found


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: its id (a long), n_lines before dropping, n_dropped, text without the dropped lines.

    A line counts by its key: ASCII white space at its ends is taken off, A-Z are a-z. Lines whose key has least_chars code points and is in
    least_docs documents go from all documents but the one with the greatest id; all its own repeats stay there. A null or empty text is one
    empty line. Rows that share an id count as documents of their own and are treated alike; null ids are below all others. An empty table
    gives an empty result; other columns are not read. docs is read twice and has to give the same rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.md5(F.concat_ws("|", common.id_text(id_col), text)).alias("own")  # names a row by what it holds
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), own, text.alias("text"))
    held = common.stored(rows.select("doc_id", "own", lines_of(F.col("text"), least_chars).alias("lines")).filter(F.size("lines") > 0))
    repeated = repeated_lines(held, least_docs, batches)
    entries = common.sieved(held.select("doc_id", "own", F.explode("lines").alias("x")).select("doc_id", "own", "x.pos", "x.line"), repeated.select("line"), "line")
    entries = common.stored(entries)
    counts = entries.groupBy("line").agg(F.count("*").alias("n"))
    hits = common.join_with_hot_keys(entries, common.stored(repeated.join(counts, "line")), "line", "n").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = hits.groupBy("own").agg(F.collect_set("pos").alias("gone"))
    out = rows.join(gone, "own", "left")
    # in an array of one, so that a text is split once and not once a line
    whole = F.array(F.struct(F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")))
    kept = F.transform(whole, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"]), lambda p: x["lines"][p]), "\n"))[0]
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select(F.col("doc_id").alias(id_col), n_lines.alias("n_lines"), dropped.alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(text_col))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = rf"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP13_SQL = f"""WITH texts AS (SELECT doc_id, row_number() OVER () AS own, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, own, i, l[i] AS line FROM (SELECT doc_id, own, l, unnest(range(1, len(l) + 1)) AS i FROM texts)),
keys AS (SELECT *, {_KEY} AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS last FROM keys WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT own) >= {LEAST_DOCS}),
marked AS (SELECT keys.*, repeated.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keys LEFT JOIN repeated USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY own"""

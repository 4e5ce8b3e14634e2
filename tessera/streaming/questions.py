"""Questions as a stream: lines of many sessions, each answered once, until a session ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.buckets import BucketTable

LINES = "session string, turn long, text string"
ANSWERS = "id string, session string, turn long, question string, answer string"


class QuestionLog:
    """What was asked and answered, by (session, turn), and where each session ended: two bucketed tables in a folder.

    Both are written by upserts of what a micro-batch touches, so a batch that is run again changes nothing: a session's end is the least
    one, an answered question is not put again. Sessions are never gathered: of a batch only each session's first exit word is.
    """

    def __init__(self, spark: SparkSession, at: str, buckets: int = 64):
        self.ended = BucketTable(spark, f"{at.rstrip('/')}/ended", "session string, stop long", "session", buckets)
        self.answers = BucketTable(spark, f"{at.rstrip('/')}/answers", ANSWERS, "id", buckets)

    def take(self, lines: DataFrame, answered: Callable[[DataFrame], DataFrame]) -> None:
        """Puts the questions among lines (session, turn, text) to `answered`: (id, session, turn, question) to the same with answer.

        Blank lines and those from the first exit word of their session on are passed over, whether it came in this batch or before. A
        line that was answered before a late exit word came stays answered.
        """
        rows = lines.select(F.coalesce("session", F.lit("")).alias("session"), "turn", T.question(F.col("text")).alias("question")).filter("question <> ''")
        rows = rows.select(F.sha2(F.concat_ws("|", F.col("turn").cast("string"), "session"), 256).alias("id"), "*").dropDuplicates(["id"])
        rows = rows.persist()
        try:
            stops = rows.filter(T.is_exit(F.col("question"))).groupBy("session").agg(F.min("turn").alias("stop"))
            known = self._some(self.ended, rows)
            self.ended.upsert(stops.unionByName(known).groupBy("session").agg(F.min("stop").alias("stop")))
            ended = self._some(self.ended, rows).withColumnRenamed("session", "_of")
            asked = rows.join(ended, rows["session"] == ended["_of"], "left").filter(F.col("stop").isNull() | (F.col("turn") < F.col("stop"))).select(*rows.columns)
            new = asked.join(self._some(self.answers, rows).select("id"), "id", "left_anti")
            found = answered(new).persist()  # an upsert reads twice, a model is asked once
            try:
                self.answers.upsert(found)
            finally:
                found.unpersist()
        finally:
            rows.unpersist()

    @staticmethod
    def _some(table: BucketTable, rows: DataFrame) -> DataFrame:
        """The rows of a table's buckets that `rows` fall into."""
        base = table.manifest()
        return table.read(base["version"] or None, table.touched(rows, base))


def follow_questions(lines: DataFrame, log: QuestionLog, checkpoint: str, answered: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Starts the stream over lines (session, turn, text). `answered` is called once a micro-batch, so it may read the store anew each time."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: log.take(batch, answered))
    return (writer.trigger(availableNow=True) if once else writer).start()


def answers_from(store: Callable[[], DataFrame], chain) -> Callable[[DataFrame], DataFrame]:
    """Answers by a chain (plans.answer.chain, with qid_col `id`) over what store() reads as a micro-batch begins."""
    return lambda asked: chain(store()).over(asked, "question", "answer")

"""From ranked chunks to contexts, prompts and answers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def contexts(ranked: DataFrame, questions: DataFrame, qid_col: str = "qid", file_col: str = "source_file", page_col: str = "page", text_col: str = "document") -> DataFrame:
    """questions with context: the labelled chunks in the order of their ranks, a blank line between; empty where nothing was found."""
    blocks = ranked.select(F.col(qid_col).alias("_qid"), "rank", T.label(F.col(file_col), F.col(page_col), F.col(text_col)).alias("x"))
    joined = blocks.groupBy("_qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda s: s["x"]), "\n\n").alias("context"))
    out = questions.join(joined, questions[qid_col] == joined["_qid"], "left").drop("_qid")
    return out.withColumn("context", F.coalesce("context", F.lit("")))


def prompts(with_context: DataFrame, question_col: str = "question", template: str = T.PROMPT) -> DataFrame:
    return with_context.withColumn("prompt", T.prompt(F.col("context"), F.col(question_col), template))


def cleaned(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    return answers.withColumn(answer_col, T.strip_think(F.col(answer_col)))


def asked_questions(lines: DataFrame, session: str, order: str, text_col: str = "text") -> DataFrame:
    """The questions of each session that would be put: stripped, not blank, and before the first exit word, columns (session, order, question).

    The first exit word of a session is a minimum (pre-aggregated), so long sessions are not gathered in one task.
    """
    rows = lines.select(session, order, T.question(F.col(text_col)).alias("question"))
    stops = rows.filter(T.is_exit(F.col("question"))).groupBy(session).agg(F.min(order).alias("_stop")).withColumnRenamed(session, "_session")
    out = rows.join(stops, rows[session].eqNullSafe(stops["_session"]), "left")
    return out.filter((F.col("question") != "") & (F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))).select(session, order, "question")


def until_exit(lines: Iterable[str]) -> Iterator[str]:
    """asked_questions() of one session whose lines come one by one."""
    for line in lines:
        asked = line.strip()
        if asked.lower() in T.EXIT_WORDS:
            return
        if asked:
            yield asked


def answering_to(name: Column) -> Column:
    """What a model may be called by whom it is installed as `name`: the name itself, and what is left of each colon (`model` for `model:tag`)."""
    parts = F.split(name, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))


def missing_models(needed: DataFrame, installed: DataFrame, server_col: str | None = None) -> DataFrame:
    """Needed models (model, priority) that no installed name equals or tags (`model:tag`); with server_col, of each server on its own.

    Names are brought into the form in which they are asked for, so this is an equality join however many servers and models there are.
    """
    on = [*([server_col] if server_col else []), "model"]
    names = installed.select(*on[:-1], F.explode(answering_to(F.col("name"))).alias("model")).distinct()
    return needed.join(names, on, "left_anti")


def needed_models(servers: DataFrame, embed: Column, chat: Column, asks: Column) -> DataFrame:
    """The models that servers need, a row each: the embedding model (priority 0) always, the chat model (1) where `asks` holds."""
    own = servers.columns
    first = servers.select(*own, embed.alias("model"), F.lit(0).alias("priority"))
    return first.unionByName(servers.filter(asks).select(*own, chat.alias("model"), F.lit(1).alias("priority")))


def installed_models(catalogue: Column) -> Column:
    """The names in a model server's catalogue JSON, as an array."""
    return F.transform(F.from_json(catalogue, "models array<struct<name string>>")["models"], lambda m: m["name"])

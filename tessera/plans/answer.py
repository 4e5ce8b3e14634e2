"""Answers: questions to vectors, nearest chunks, context, prompt, generated and cleaned text, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.template import Template
from ..functions.text import PROMPT, strip_think
from ..functions.text import question as trimmed
from ..operators.answering import contexts
from ..operators.models import Embedder, Generator, with_answers, with_embeddings
from ..operators.retrieval import top_batch
from ..operators.stages import Stage, expression, passed, record, table


def retrieve(store: DataFrame, questions: DataFrame, k: int, embedder: Embedder) -> DataFrame:
    """qid, rank, distance and the columns of the k nearest chunks of each question (qid, question)."""
    asked = with_embeddings(questions.select("qid", trimmed(F.col("question")).alias("question")), embedder, "question", name="vector")
    best = top_batch(store.select("id", "embedding"), asked, k)
    return best.join(store.drop("embedding"), "id")


def retriever(store: DataFrame, k: int, embedder: Embedder, qid_col: str = "qid") -> Stage:
    """A stage from a question to its labelled context; rows are told apart by qid_col."""

    def into(rows: DataFrame, column: str, name: str) -> DataFrame:
        asked = rows.select(F.col(qid_col).alias("qid"), F.col(column).alias("question"))
        found = contexts(retrieve(store, asked, k, embedder), asked).select(F.col("qid").alias("_of"), F.col("context").alias(name))
        return rows.join(found, rows[qid_col] == found["_of"]).drop("_of")

    return table(into)


def model(generator: Generator) -> Stage:
    """A stage from a prompt to the raw answer."""
    return table(lambda rows, column, name: with_answers(rows, generator, column, name))


def chain(store: DataFrame, k: int, embedder: Embedder, generator: Generator, template: str = PROMPT, qid_col: str = "qid") -> Stage:
    """From a question to its cleaned answer."""
    return record(context=retriever(store, k, embedder, qid_col), question=passed()) | Template(template) | model(generator) | expression(strip_think)


def answer(store: DataFrame, questions: DataFrame, k: int, embedder: Embedder, generator: Generator, template: str = PROMPT) -> DataFrame:
    """questions (qid, question) with context, prompt and answer. A store without rows gives empty contexts, and the model is asked all the same."""
    asked = questions.select("qid", trimmed(F.col("question")).alias("question"))
    found = retriever(store, k, embedder).over(asked, "question", "context")
    both = expression(lambda _: F.struct("context", "question")) | Template(template)
    return (model(generator) | expression(strip_think)).over(both.over(found, "question", "prompt"), "prompt", "answer")

"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents are labelled. Each sentence has a logistic score from the features of its words, noisy-or combines the scores
into the document's, and the weights are fitted to the documents' labels; afterwards the sentences' own scores show where the
offence lies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import labelled_sample

#: About so many labelled rows, at most, are learned from.
SAMPLE = 30_000
#: Features in fewer toxic documents of the sample are left out.
LEAST_DOCS = 4
#: How far a feature's log odds must lean to toxic documents, after two standard errors are taken off.
LEAN = 1.0
#: Steps of the fit and the penalty on weights.
STEPS, PENALTY = 250, 1e-4
#: Words whose weight a worker remembers.
REMEMBERED = 400_000

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A lower-cased word itself and its beginnings of 4 to 6 letters (marked), which catch inflected forms."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence: up to and with its stops or line ends. Very long ones are cut at white space."""
    for m in SENTENCE.finditer(text):
        at = m.start()
        for block in common.blocks(m[0]):
            yield at, at + len(block)
            at += len(block)


@dataclass
class Model:
    """score(sentence) = 1 / (1 + exp(-bias - sum of weights of its distinct features)); a document: 1 - product of (1 - score)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    #: word -> the features of it that the model has; filled as texts are read
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def sentence(self, text: str) -> float:
        have = {f for w in set(WORD.findall(text.lower())) for f in self.of(w)}
        return sigmoid(self.bias + sum(self.weights[f] for f in have))

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence that has a word."""
        if text and not any(self.of(w) for b in common.blocks(text) for w in set(WORD.findall(b.lower()))):
            alone = sigmoid(self.bias)
            return [(a, b, alone) for a, b in sentences(text) if WORD.search(text, a, b)]
        return [(a, b, self.sentence(text[a:b])) for a, b in sentences(text or "") if WORD.search(text, a, b)]

    def score(self, text: str | None) -> float:
        return noisy_or([s for *_, s in self.spans(text)])


def sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def noisy_or(scores: list[float]) -> float:
    """1 - product of (1 - score); 0 for no sentence."""
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum())) if scores else 0.0


def word_features(text: str) -> set[str]:
    words = set().union(*(WORD.findall(b.lower()) for b in common.blocks(text)))
    return {f for w in words for f in features(w)}


def document_counts(sample: DataFrame, toxic: bool) -> DataFrame:
    """In how many documents of one label each feature is: counted by each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(word_features(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    rows = sample.filter(F.col("label") >= 0.5 if toxic else F.col("label") < 0.5).select("text")
    return rows.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def chosen_features(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features surely tied to toxic documents: by the lower bound of their log odds ratio, two standard errors down.

    The bound and not its significance, for that favours what is merely common in long texts. Every feature of LEAST_DOCS toxic documents
    is rated, in Spark, and every one that leans is in the model.
    """
    toxic = document_counts(sample, True).filter(F.col("n") >= LEAST_DOCS).withColumnRenamed("n", "p")
    clean = document_counts(sample, False).withColumnRenamed("n", "c")
    p, c = F.col("p"), F.coalesce("c", F.lit(0))
    odds = F.log((p + 0.5) / (n_toxic - p + 0.5)) - F.log((c + 0.5) / (n_clean - c + 0.5))
    rated = toxic.join(clean, "feature", "left").withColumn("bound", odds - 2 * F.sqrt(1 / (p + 0.5) + 1 / (c + 0.5)))
    return [r["feature"] for r in rated.filter(F.col("bound") > LEAN).orderBy(F.desc("bound"), "feature").collect()]


def fit(sample: DataFrame) -> Model:
    """A model from rows (id, text, label). The sample is bounded, and of its documents only sentences with a chosen feature come to the driver."""
    sample = common.settled(sample)
    n = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("label") >= 0.5).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return Model(bias=40.0 if n.get(True) else -20.0)
    names = chosen_features(sample, n[True], n[False])
    number = {f: i for i, f in enumerate(names)}
    reader = Model(dict.fromkeys(names, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, lengths, owner, which = [], [], [], []
            for d, text in enumerate(batch.column(0)):
                none = 0
                for a, b in sentences(text := text.as_py()):
                    if words := WORD.findall(text[a:b].lower()):
                        have = {number[f] for w in set(words) for f in reader.of(w)}
                        if have:
                            owner.append(d)
                            lengths.append(len(have))
                            which.extend(have)
                        else:
                            none += 1
                plain.append(none)
            packed = [np.asarray(x, np.int32).tobytes() for x in (batch.column(1).to_pylist(), plain, owner, lengths, which)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["label", "plain", "owner", "lengths", "which"])

    rows = sample.select("text", "label").mapInArrow(run, "label binary, plain binary, owner binary, lengths binary, which binary").collect()
    parts = [[np.frombuffer(x, np.int32) for x in r] for r in rows]
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    joined = [np.concatenate([np.empty(0, np.int64), *(p[i] + (before[k] if i == 2 else 0) for k, p in enumerate(parts))]) for i in range(5)]
    weights, bias = noisy_or_fit(*joined, len(names))
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def noisy_or_fit(labels: np.ndarray, plain: np.ndarray, owner: np.ndarray, lengths: np.ndarray, which: np.ndarray, size: int, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of least cross entropy between labels and noisy-or scores, by Adam over all documents.

    plain: sentences of each document without a feature, which all have the bias alone. Of each other sentence: its document (owner) and
    how many features it has; which: those features, one sentence after the other.
    """
    y, plain_n = labels >= 1, plain.astype(float)
    at = np.repeat(np.arange(len(owner)), lengths)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = -4.0
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[which], len(owner))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        # log of the chance that no sentence offends: log(1 - p) = -log(1 + e^z)
        clean = -np.bincount(owner, np.logaddexp(0, z), len(y)) - plain_n * np.logaddexp(0, theta[-1])
        clean = np.minimum(clean, -1e-12)
        pull = np.where(y, -np.exp(clean) / -np.expm1(clean), 1.0)  # of the loss on log(1 - p), with its sign turned
        g_z = pull[owner] * p
        grad = np.concatenate([np.bincount(which, g_z[at], size), [g_z.sum() + float((pull * plain_n).sum() * p0)]]) / len(y)
        grad[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, score (0 to 1), sentence_start, sentence_end and sentence_score of its worst sentence.

    Null and empty texts and texts without a word score 0 and have null places. Positions are code points, whole texts are read,
    repeated rows score alike, other columns are not read.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("_scored_text"), F.col(id_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, worst = [], []
            for text in batch.column(0):
                spans = model.spans(text.as_py())
                scores.append(noisy_or([s for *_, s in spans]))
                worst.append(max(spans, key=lambda x: (x[2], -x[0]), default=(None, None, None)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(scores, pa.float64()), *(pa.array([w[i] for w in worst], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))],
                [id_col, "score", "sentence_start", "sentence_end", "sentence_score"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, sentence_start long, sentence_end long, sentence_score double")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence that scores at least `least` by itself: id, start, end, sentence, score."""
    rows = docs.select(F.col(text_col).cast("string").alias("_scored_text"), F.col(id_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, a, b, text[a:b], s) for i, text in enumerate(batch.column(0).to_pylist()) for a, b, s in model.spans(text) if s >= least]
            at = pa.array([x[0] for x in out], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds, 1))], [id_col, "start", "end", "sentence", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, end long, sentence string, score double")


def op4_noisy_or_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, common.table(spark, sf_dir, "labels"), "toxic", SAMPLE))
    found = score_toxicity(docs, model).withColumn("held_out", common.held_out())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence_start", "sentence_end", "sentence_score")

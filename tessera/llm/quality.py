"""A quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics; each partition sums its part of the normal
equations, the driver solves them for ridge scores, and isotonic regression turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: About so many labelled rows, at most, are learned from.
SAMPLE = 30_000
#: Random features, kernel width in units of the square root of the number of statistics, ridge penalty per row, seed.
FEATURES, WIDTH, PENALTY, SEED = 384, 0.7, 1e-3, 7
#: Partitions of the (bounded) sample over which the normal equations are summed.
PARTS = 8
#: A document of less quality than this goes.
LEAST_SCORE = 0.3

STATISTICS = [
    "log_chars", "log_words", "mean_word", "spread_word", "alphabetic", "digit", "space", "upper", "bar", "exclamation", "mark", "other",
    "alphabetic_words", "upper_words", "short_words", "long_words", "distinct_words", "top_word", "repeated_next", "lines", "distinct_lines", "entropy", "symbol_ends",
]

_classes: list[np.ndarray] = []
KINDS = 7


def classes() -> np.ndarray:
    """The kind of each code point: 0 other, 1 letter that isn't upper case, 2 upper case, 3 digit, 4 white space, 5 stop and comma, 6 the rest of ASCII."""
    if not _classes:
        kinds = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            kinds[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:'\"-()?" else 6 if i < 128 else 0
        _classes.append(kinds)
    return _classes[0]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, worked out in blocks; all 0 for a null, empty or blank text."""
    text = text or ""
    chars, kinds = np.zeros(256, np.int64), np.zeros(KINDS, np.int64)
    words: Counter[str] = Counter()
    lines: Counter[int] = Counter()
    n = total = squares = alphabetic = upper = short = long = same = ends = 0
    last = None
    for block in common.blocks(text):
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
        chars += np.bincount(np.minimum(points, 255), minlength=256)
        kinds += np.bincount(classes()[points], minlength=KINDS)
        own = block.split()
        if not own:
            continue
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        n += len(own)
        total += int(lengths.sum())
        squares += int((lengths * lengths).sum())
        short += int((lengths <= 3).sum())
        long += int((lengths >= 12).sum())
        alphabetic += sum(map(str.isalpha, own))
        upper += sum(map(str.isupper, own))
        ends += len(own) - sum(map(str.isalnum, (w[-1] for w in own)))
        same += sum(map(str.__eq__, own, [last or "", *own[:-1]]))
        last = own[-1]
        words.update(own)
        lines.update(map(hash, block.split("\n")))
    if not n:
        return np.zeros(len(STATISTICS))
    size, n_lines = int(kinds.sum()), sum(lines.values())
    share = chars[chars > 0] / size
    mean = total / n
    return np.array([
        np.log1p(size), np.log1p(n), mean, np.sqrt(max(0.0, squares / n - mean * mean)), (kinds[1] + kinds[2]) / size, kinds[3] / size, kinds[4] / size,
        kinds[2] / size, chars[ord("|")] / size, chars[ord("!")] / size, kinds[5] / size, (kinds[0] + kinds[6]) / size,
        alphabetic / n, upper / n, short / n, long / n, len(words) / n, max(words.values()) / n, same / n,
        np.log1p(n_lines), len(lines) / n_lines, -float((share * np.log(share)).sum()), ends / n,
    ])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x rising, y not falling) between which a score is read off along straight lines."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, of x, count
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, a, 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    #: The share of label 1: what is said of every text where nothing could be learned.
    prior: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        """Rows of statistics to rows of random Fourier features, then the clipped statistics themselves and 1."""
        z = np.clip((x - self.mean) / self.spread, -5.0, 5.0)
        waves = np.sqrt(2.0 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z / 5.0, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns text and label of about `most` labelled rows at most that aren't held out, settled. Null labels and null ids teach nothing; a repeated row teaches again."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna().filter(~common.held_out("id"))
    ids = common.bounded_sample(ids, F.col("id"), most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample is bounded (16 bytes a row), so it goes to the texts and not the texts to it
    return texts.join(F.broadcast(ids), "id").select("id", "text", "label")


def fit(sample: DataFrame, features: int = FEATURES, seed: int = SEED) -> Model:
    """A model from rows (id, text, label). A quarter of the rows, by hash of the id, sets the steps of the calibration and not the weights."""
    names = [f"x{i}" for i in range(len(STATISTICS))]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(2), batch.column(3)], [*names, "label", "own"])

    rows = sample.select("id", "text", "label", (F.pmod(F.xxhash64("id", F.lit("steps")), F.lit(4)) == 0).alias("own"))
    table = common.settled(rows.mapInArrow(stats, ", ".join(f"{c} double" for c in names) + ", label double, own boolean").repartition(PARTS))
    head = table.agg(F.count("*"), F.avg("label"), *(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
    if not head[0]:
        return Model(*[np.zeros(0)] * 2, np.zeros((0, 0)), *[np.zeros(0)] * 2, (np.zeros(0), np.zeros(0)))
    mean, spread = (np.array(head[at : at + len(names)], float) for at in (2, 2 + len(names)))
    spread[spread < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    width = WIDTH * np.sqrt(len(names))
    model = Model(mean, spread, rng.normal(0.0, 1.0 / width, (len(names), features)), rng.uniform(0.0, 2 * np.pi, features), np.zeros(1), (np.zeros(1), np.zeros(1)), head[1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = features + len(names) + 1
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x, y, own = (np.column_stack([batch.column(c).to_numpy() for c in names]), batch.column("label").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False))
            z = model.features(x[~own])
            a, b, n = a + z.T @ z, b + z.T @ y[~own], n + len(z)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["n", "a", "b"])

    parts = table.mapInArrow(sums, "n long, a binary, b binary").collect()  # PARTS rows
    size = features + len(names) + 1
    a, b, n = sum(np.frombuffer(p["a"]).reshape(size, size) for p in parts), sum(np.frombuffer(p["b"]) for p in parts), sum(p["n"] for p in parts)
    penalty = PENALTY * max(1, n) * np.eye(size)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + penalty, b)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in names])
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), batch.column("label")], ["score", "label"])

    calibration = table.filter("own") if n and n < head[0] else table
    pairs = np.array(calibration.mapInArrow(scores, "score double, label double").collect(), float).reshape(-1, 2)  # a quarter of the sample
    model.steps = isotonic(pairs[:, 0], pairs[:, 1])
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """A row per document: its id (or the columns `keep`) and `into`, the probability of label 1.

    Null, empty and blank texts have all statistics 0 and the score that goes with that; without any labelled text every score is
    0.5. Repeated rows score alike. Other columns are not read, so theirs may have any name.
    """
    keep = keep or [id_col]
    rows = docs.select(F.col(text_col).cast("string").alias("_scored_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(0)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(x))], [*keep, into])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, `{into}` double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose quality is at least `least`, learned from the labels of docs; columns as they were. Without labels all stay."""
    model = fit(labelled_sample(docs, labels, "quality"))
    rows, text = common.placed(docs)
    return score_quality(rows, model, text_col=text, keep=rows.columns, into="quality").filter(F.col("quality") >= least).select(*rows.columns).toDF(*docs.columns)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, common.table(spark, sf_dir, "labels"), "quality"))
    return score_quality(docs, model).select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

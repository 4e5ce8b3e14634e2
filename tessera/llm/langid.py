"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams in order; a document's own profile is compared to each by the out-of-place
distance (how many ranks each n-gram stands from where the language has it), and the nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: N-grams in a profile.
RANKS = 400
#: Counts of n-grams that a task holds at most while it learns.
HELD = 4_000_000
#: What stands for the gaps between words; not a letter, and above 0 so that n-grams of different lengths differ as numbers.
GAP = 1
UNKNOWN = "und"
#: A text whose best language scores less is in none of the languages: n-grams strewn at random score about 0.1, prose 0.4 or more.
LEAST_SCORE = 0.2

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The n-grams (1 to 3 letters, with the gap at either end of a word) of a lower-cased text, as numbers of 21 bits a letter; repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    line = np.full(len(points) + 2, GAP, np.int64)
    line[1:-1][is_letter] = points[is_letter]
    line = line[np.concatenate([[True], (line[1:] != GAP) | (line[:-1] != GAP)])]
    two = line[:-1] << 21 | line[1:]
    three = (two[:-1] << 21 | line[2:])[line[1:-1] != GAP]
    return np.concatenate([line[line != GAP], two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text and their counts, worked out in blocks that end between words."""
    parts = [np.unique(grams(b), return_counts=True) for b in common.blocks(text)]
    return parts[0] if len(parts) == 1 else summed(parts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by number."""
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


@dataclass
class Profiles:
    """For each language (in name order) the rank of every n-gram that some profile has; `ranks` where its own has not."""

    languages: list[str]
    keys: np.ndarray
    table: np.ndarray
    ranks: int

    @classmethod
    def of(cls, tops: dict[str, np.ndarray], ranks: int) -> Profiles:
        languages = sorted(tops)
        keys = np.unique(np.concatenate([np.empty(0, np.int64), *(tops[x] for x in languages)]))
        table = np.full((len(languages), len(keys)), ranks, np.int32)
        for i, x in enumerate(languages):
            table[i, np.searchsorted(keys, tops[x])] = np.arange(len(tops[x]))
        return cls(languages, keys, table, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: 1 less the distance's share of the greatest possible one. Ties go to the first name."""
        keys, counts = counted(text) if text else (np.empty(0, np.int64), None)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        own = top(keys, counts, self.ranks)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        away = np.abs(self.table[:, at[known]] - np.flatnonzero(known).astype(np.int32))
        away = np.where(self.table[:, at[known]] == self.ranks, self.ranks, away)
        distance = away.sum(axis=1) + self.ranks * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.ranks * len(own))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", ranks: int = RANKS) -> Profiles:
    """Profiles from all rows of docs with a language and a text.

    Each task counts the n-grams of its rows by language, the counts are summed by n-gram, and only the first `ranks` of each
    language come to the driver. One short job per language follows the counting; languages are few.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def shrunk() -> int:
            for parts in held.values():
                parts[:] = [summed(parts)]
            return sum(len(parts[0][0]) for parts in held.values())

        def given() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, counts),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = counted(text.as_py())
                held.setdefault(lang.as_py(), []).append(found)
                size += len(found[0])
                if size > HELD and (size := shrunk()) > HELD // 2:
                    yield from given()  # what many languages or scripts have is summed later on
                    size = 0
        shrunk()
        yield from given()

    counts = common.settled(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    tops = {}
    for (lang,) in counts.select("lang").distinct().collect():
        first = counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(ranks).collect()
        tops[lang] = np.array([r["gram"] for r in first], np.int64)
    return Profiles.of(tops, ranks)


def identify_languages(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """A row per document: its id (or the columns `keep`) and, named by `into`, the language and the score (0 to 1).

    Null and empty texts, and texts without a letter, are `und` with score 0, as is everything where no language was learned.
    Repeated rows each get their row; other columns are not read, so theirs may have any name.
    """
    keep = keep or [id_col]
    rows = docs.select(F.col(text_col).cast("string").alias("_read_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, *into])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, `{into[0]}` string, `{into[1]}` double")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in one of the languages that docs itself teaches (all its labelled rows that aren't held out), columns as they were. Where nothing is labelled all stay."""
    profiles = learn_profiles(docs.filter(~common.held_out()))
    if not profiles.languages:
        return docs
    rows, text = common.placed(docs)
    rated = identify_languages(rows, profiles, text_col=text, keep=rows.columns, into=("language", "nearness"))
    return rated.filter((F.col("language") != UNKNOWN) & (F.col("nearness") >= least)).select(*rows.columns).toDF(*docs.columns)


def op1_rank_order_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn_profiles(docs.filter(~common.held_out())))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")

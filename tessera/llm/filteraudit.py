"""How filters overlap: what each removes in every order they can be applied in, from one count of which documents fail which filters.

A document's failures are the bits of a mask. Per part and label the masks' Walsh-Hadamard coefficients are summed, one signed parity for
each subset of filters; the transform is its own inverse up to a factor, so the sums give back exactly how many documents have each mask,
and every order, step and Shapley value follows from those 32 numbers.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c").__contains__
UPPER, SYMBOLS = string.ascii_uppercase.encode(), re.compile(rb"[#$%&*|]")
#: Few words, few distinct ones, many capitals, symbols, a copy of an earlier document: the bits of a mask from the lowest on.
NAMES, LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = "ABCDE", 200, 50, 2
LABELS = ("all", "good", "toxic")


def failing(text: str | None) -> int:
    """The mask of filters A to D that a whole text fails; a null text is an empty one."""
    words, distinct, upper, symbol = 0, set(), 0, False
    for block in common.blocks(text, space=ASCII_SPACE) if text else ():
        raw = block.encode("utf-8", "surrogatepass")
        found = raw.split()
        words += len(found)
        distinct.update(found)
        upper += len(raw) - len(raw.translate(None, UPPER))
        symbol = symbol or SYMBOLS.search(raw) is not None
    fails = words < LEAST_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * len(text or ""), symbol
    return sum(bit << k for k, bit in enumerate(fails))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) per document, the mask with E: whether a smaller id has the same text. Texts are compared by SHA-256.

    A null id is no document's smaller id and has none itself; rows that share an id are not copies of each other. A text that a third of
    all rows share meets its smallest id where its rows are.
    """

    @F.pandas_udf("int")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(failing).astype("int32")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask(text).alias("mask"))
    rows = common.stored(rows)
    own = common.stored(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return common.join_with_hot_keys(rows, own, "digest", "n").select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (id, part, mask) with good and toxic: whether some row of labels has quality = 1, toxic = 1 for the id; null ids have no labels."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias
    marks = labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col(id_col).alias("id")).agg(one("quality")("good"), one("toxic")("toxic"))
    none = rows.filter("id IS NULL").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    found = rows.filter("id IS NOT NULL").join(marks, "id", "left").unionByName(none)
    return found.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def sign(mask: Column, subset) -> Column:
    """1 where mask and subset share an even number of filters, else -1: a Walsh function."""
    return F.lit(1) - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def parities(rows: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """(part, label, sums): a signed parity sum for each of the 2 ** filters subsets over the documents of each part and label.

    Rows (part, mask, good, toxic); sums are made in each task before the shuffle, so a part with most of the rows is a row a task.
    """
    kinds = F.array_compact(F.array(F.lit("all"), *(F.when(F.col(c), F.lit(c)) for c in LABELS[1:])))
    each = rows.select("part", "mask", F.explode(kinds).alias("label"))
    sums = [F.sum(sign(F.col("mask"), F.lit(w))).alias(f"s{w}") for w in range(1 << filters)]
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{w}" for w in range(1 << filters))).alias("sums"))


def cells(sums: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """(part, all, good, toxic): arrays of how many documents have each mask, by the inverse transform, which leaves no remainder."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    total = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda a, w: a + sign(m, w) * F.col("sums")[w])
    counts = F.transform(every, lambda m: F.shiftright(total(m), filters))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << filters)
    rows = sums.select("part", "label", counts.alias("cells"))
    return rows.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == c, F.col("cells"))), none).alias(c) for c in LABELS))


def orders(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """Per part, order of the filters and step: what is kept and removed there. counts: as of cells()."""
    n, ways = len(names), math.factorial(len(names))
    bits = lambda letters: sum(1 << names.index(c) for c in letters)
    steps = [{"filter_order": "".join(p), "step": k + 1, "own": bits(p[k]), "before": bits(p[:k])} for p in permutations(names) for k in range(n)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, own int, before int>>")
    rows = counts.withColumn("at", F.explode(steps)).select("*", "at.*")
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    hit = lambda m, of: m.bitwiseAND(F.col(of)) != 0

    def count(of: str, keep, weight=lambda m: 1) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(keep(m), F.col(of)[m] * weight(m)).otherwise(0))

    here = lambda m: hit(m, "own") & ~hit(m, "before")
    share = lambda m: F.floor(F.lit(ways) / F.bit_count(m))  # noqa: E731  of the orders, those in which one of a mask's filters comes first
    return rows.select(
        "part", "filter_order", "step",
        count("all", lambda m: ~hit(m, "own") & ~hit(m, "before")).alias("kept"),
        count("all", here).alias("removed"),
        count("all", lambda m: hit(m, "own") & hit(m, "before")).alias("redundant"),
        F.col("all")[F.col("own")].alias("unique_fails"),
        count("good", here).alias("good_lost"),
        count("toxic", here).alias("toxic_lost"),
        count("all", lambda m: hit(m, "own"), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part, order of the five filters and step, with long counts of the part's documents.

    kept after the step; removed here; redundant: failing the step's filter but removed earlier; unique_fails: failing no other filter;
    good_lost, toxic_lost: removed here with that label; shapley: the filter's removed documents, summed over all orders. A null part is
    the empty one, a null text an empty one; repeated rows count as often as they occur, repeated labels once. An empty table gives an
    empty result; other columns are not read.
    """
    return orders(cells(parities(labelled(masked(docs, id_col, text_col, part_col), labels, id_col))))


def op12_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(txt, '[^\x20\x09-\x0D]+')"

OP12_SQL = rf"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents),
firsts AS (SELECT txt, min(doc_id) AS least FROM texts GROUP BY txt),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 2 * length(txt) AS INTEGER)
    + 8 * CAST(regexp_matches(txt, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask
  FROM (SELECT *, {_WORDS} AS w FROM texts) JOIN firsts USING (txt) LEFT JOIN marks USING (doc_id)
), counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, bit_count(mask) AS f FROM masks GROUP BY part, mask),
letters AS (SELECT chr(65 + CAST(i AS INTEGER)) AS c, CAST(1 << i AS INTEGER) AS own FROM range(5) r(i)),
orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, letters WHERE NOT contains(o, c)),
steps AS (
  SELECT o AS filter_order, CAST(step AS INTEGER) AS step, (SELECT own FROM letters WHERE c = substring(o, CAST(step AS INTEGER), 1)) AS own,
    (SELECT coalesce(sum(own), 0)::INTEGER FROM letters WHERE contains(substring(o, 1, CAST(step - 1 AS INTEGER)), c)) AS before
  FROM orders, range(1, 6) r(step) WHERE length(o) = 5
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(f, 1))) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, linededup

from .conftest import DOCS, EN, prose, rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def expected(docs, least=5):
    """The rule row by row: rows that share an id are documents of their own, a null id is below all others."""
    holders = defaultdict(list)
    for i, text, *_ in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(-1 if i is None else i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= least}
    out = []
    for i, text, *_ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x)) in (None, -1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    shared = [prose(rng, EN, 12) for _ in range(30)] + ["É" + "ä" * 38 + "Z", "x" * 39, "X" * 40, " " + "y" * 39 + " "]
    out = [(1, None, None, None, None), (2, "", None, None, 0), (3, "\n\n", None, None, 2)]
    for i in range(10, 130):
        lines = [prose(rng, EN, rng.randint(1, 20)) for _ in range(rng.randint(0, 4))]
        lines += [rng.choice([str, str.upper, lambda x: f"\t {x} \r\x0b"])(x) for x in rng.choices(shared, k=rng.randint(0, 5))]
        rng.shuffle(lines)
        out.append((rng.choice([i, i, i, i, None]) if i < 40 else i, "\n".join(lines), "en", "s", 1))
    out += [out[50]] * 6 + [(500 + k, shared[0], "en", "s", 1) for k in range(60)] + [(7, shared[1] + "\n" + shared[1], "en", "s", 1), (None, "only null ids hold this one, which is long enough", "en", "s", 1)]
    out += [(None, "only null ids hold this one, which is long enough", "en", "s", 1)] * 5
    return out


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_lines(spark, docs, batches):
    got = linededup.drop_repeated_lines(spark.createDataFrame(docs, DOCS).repartition(3), batches=batches)
    assert rows_of(got) == expected(docs)
    assert not [x for x in os.listdir(common.shared_dir(spark).removeprefix("file:")) if x.startswith("lines-")]


def test_other_limits(spark, docs):
    got = linededup.drop_repeated_lines(spark.createDataFrame(docs, DOCS), least_docs=2, batches=4)
    assert rows_of(got) == expected(docs, 2)


def test_runs_are_levelled_and_settled_lines_are_not_added_again(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), settled=2, fanout=2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "line string, doc_id long")
    held = lambda: sorted(tuple(r) for r in runs.merged(runs.names()).collect())
    runs.add(batch(("a", 9), ("a", 8), ("b", 9)))
    assert [len(x) for x in runs.levels] == [1] and held() == [("a", 2, 9), ("b", 1, 9)]
    runs.add(batch(("a", 7), ("b", 6), ("c", 5)))  # a is settled
    assert [len(x) for x in runs.levels] == [0, 1] and held() == [("a", 2, 9), ("b", 2, 9), ("c", 1, 5)]
    runs.add(batch(("a", 20), ("b", None), ("c", 4)))  # a greater id counts even for a settled line
    assert [len(x) for x in runs.levels] == [1, 1] and held() == [("a", 3, 20), ("b", 2, 9), ("c", 2, 5)]
    runs.add(batch(("a", 1)))
    runs.add(batch(("d", 1)))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and held() == [("a", 3, 20), ("b", 2, 9), ("c", 2, 5), ("d", 1, 1)]
    runs.close()
    assert not (tmp_path / "runs").exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_long_text(spark):
    lines = [f"line number {i % 500} of a long document that goes on for long" for i in range(20_000)]
    docs = [(i, "\n".join(lines), "en", "s", 1) for i in range(5)]
    got = {r["doc_id"]: tuple(r)[1:] for r in linededup.drop_repeated_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[4] == (20_000, 0, "\n".join(lines)) and all(got[i] == (20_000, 20_000, "") for i in range(4))


def test_edges(spark, corpus, clashing):
    docs = corpus[0]
    more = clashing(docs)
    for c in ("own", "lines", "line", "last", "docs", "gone", "pos", "n", "known", "upto"):
        more = more.withColumn(c, F.lit("x"))
    assert rows_of(linededup.drop_repeated_lines(more)) == rows_of(linededup.drop_repeated_lines(docs)) == expected([tuple(r) for r in docs.collect()])
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, None, None, None, None)] * 6, DOCS)
    assert {tuple(r) for r in linededup.drop_repeated_lines(null).collect()} == {(None, 1, 0, "")}

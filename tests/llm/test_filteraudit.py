import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import filteraudit

from .conftest import DOCS, EN, rows_of

LABELS = "doc_id long, quality int, toxic int"


def fails(doc_id, text, texts):
    """The letters of the filters that a document fails, straight from their definitions."""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    rules = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in text for c in "#$%&*|"),
        "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in texts),
    }
    return {k for k, v in rules.items() if v}


def expected(docs, labels):
    """Every order applied to every document, one step after the other."""
    texts = [(d[0], d[1] or "") for d in docs]
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    found = [(d[0], d[3] or "", fails(d[0], d[1] or "", texts)) for d in docs]
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out, removed_by = [], {}
    for part in {p for _, p, _ in found}:
        own = [x for x in found if x[1] == part]
        for order in orders:
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[2]]
                left = [x for x in left if letter not in x[2]]
                redundant = sum(letter in x[2] for x in own) - len(gone)
                unique = sum(x[2] == {letter} for x in own)
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), redundant, unique, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), letter])
    return sorted(repr((*r[:9], removed_by[r[0], r[9]])) for r in out)


@pytest.fixture(scope="module")
def tables(spark):
    rng, docs = random.Random(3), [(1, None, None, None, None), (2, "", None, "", 0), (None, "", None, "s0", 0), (None, "x", None, None, 1)]
    for i in range(10, 140):
        words = rng.choices(EN[: rng.choice([5, 90])], k=rng.choice([3, 199, 200, 260]))
        text = " ".join(w.upper() if rng.random() < rng.choice([0, 0.2]) else w for w in words) + rng.choice(["", " #", " Ä", " \n"])
        docs.append((i, text, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(text)))
    docs += [(200 + k, docs[20 + k % 5][1], "en", "s1", 1) for k in range(30)] + [docs[30], docs[30], (5, docs[40][1], "en", "s0", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(10, 220, 2)] + [(12, 1, 1), (12, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_whole_audit(spark, tables):
    docs, labels = tables
    got = filteraudit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert rows_of(got) == expected(docs, labels)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7


def test_transform_gives_back_every_cell(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randint(0, 2)}", rng.randint(0, 31), rng.random() < 0.3, rng.random() < 0.1) for _ in range(500)] + [("one", 31, False, True)]
    got = filteraudit.cells(filteraudit.parities(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))).collect()
    assert len(got) == 4
    for r in got:
        own = [x for x in rows if x[0] == r["part"]]
        for label, keep in (("all", own), ("good", [x for x in own if x[2]]), ("toxic", [x for x in own if x[3]])):
            assert r[label] == [sum(x[1] == m for x in keep) for m in range(32)]


def test_texts_in_blocks(monkeypatch, tables):
    whole = [filteraudit.failing(d[1]) for d in tables[0]]
    monkeypatch.setattr(filteraudit.common.blocks, "__defaults__", (13, str.isspace))
    assert [filteraudit.failing(d[1]) for d in tables[0]] == whole
    assert filteraudit.failing("Word " * 300_000) == 2 | 4


def test_edges(spark, corpus, clashing):
    docs, labels = corpus
    more = clashing(docs).withColumn("mask", F.lit("m")).withColumn("part", F.lit("p")).withColumn("least", F.lit(0)).withColumn("n", F.lit(0))
    assert rows_of(filteraudit.audit(more, clashing(labels))) == rows_of(filteraudit.audit(docs, labels)) == expected([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    none = filteraudit.audit(docs, labels.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and none.count() == 600 * docs.fillna({"source": ""}).select("source").distinct().count()

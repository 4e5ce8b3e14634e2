import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fim

from .conftest import rows_of

ALPHABET = ["a", "b ", " ", "\n", "\t", "\x0b\x0c", "\r", " ", " ", "é", "😀", "<", "P>", "S>", "M", ">", "word", "\x1c"]


def expected(doc_id, text):
    """The rule, spelled out with lists of units."""
    units = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text)
    digest = hashlib.sha256(("42:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i * 8 : i * 8 + 8], 16) for i in range(4))
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(400)]
    return [None, "", " ", "\n", "x", "a <M> b", "<P", "a" * 200_000, "b " * 200_000, " " * 200_000, *made]


def test_rows(spark, texts):
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.fill_in_middle(docs).collect()}
    assert got == {None if i == 5 else i: expected(None if i == 5 else i, t or "") for i, t in enumerate(texts)}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_every_form_is_restored(texts):
    for i, text in enumerate(t or "" for t in texts):
        for key in range(8):
            n, form, _, _, output = fim.transformed(f"{i}-{key}", text, percent=100, spm_percent=50)
            assert fim.restored(output, form) == text and n == len(fim.unit_ends(text))
            assert form == "plain" or output.count("<P>") == output.count("<S>") == output.count("<M>") == 1


def test_query(spark, corpus, tmp_path):
    docs = corpus[0]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d in docs.collect():
        n, form, p, m, output = expected(d["doc_id"], d["text"] or "")
        want.append((d["doc_id"], n, form, p, m, sha(output), sha(d["text"] or "")))
    assert rows_of(fim.op11_fill_in_middle(spark, str(tmp_path))) == sorted(map(repr, want))


def test_edges(spark, corpus, clashing):
    docs = corpus[0]
    assert rows_of(fim.fill_in_middle(clashing(docs).withColumn("_made", F.lit(1)))) == rows_of(fim.fill_in_middle(docs))
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    twice = rows_of(fim.fill_in_middle(docs.filter("doc_id = 1").unionByName(docs.filter("doc_id = 1"))))
    assert len(twice) == 2 and len(set(twice)) == 1
    assert {r["form"] for r in fim.fill_in_middle(docs, percent=0).collect()} == {"plain"}

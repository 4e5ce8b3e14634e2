import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_strip_like_python(spark):
    cases = [chr(c) + "a" + chr(c) + "b" + chr(c) for c in [*WHITE, 0x200B, 0x180E]] + ["", "   ", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", T.strip(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [None if x is None else x.strip() for x in cases]


@pytest.mark.parametrize(("raw", "want"), [("ab<think>x\ny</think>c", "abc"), ("a<think>x", "a<think>x"), ("<think>a<think>b</think>c</think>", "c</think>"), ("<THINK>a</THINK>", "<THINK>a</THINK>"), (" <think></think> ", "")])
def test_think(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.strip_think(F.col("x"))).first()[0] == want


def test_ids(spark):
    rows = spark.createDataFrame([("f.pdf", 0, 0, "t"), (None, None, 1, "t"), ("f.pdf", 0, 1, "t")], "f string, p int, i int, t string")
    got = [r[0] for r in rows.select(T.chunk_id(F.col("f"), F.col("p"), F.col("i"), F.col("t"))).collect()]
    assert got == [hashlib.sha256(k.encode()).hexdigest() for k in ("f.pdf|0|0|t", "||1|t", "f.pdf|0|1|t")]


def test_prompt_keeps_what_it_is_given(spark):
    odd = "$1 \\ {x} {context} {question}"
    got = spark.createDataFrame([(odd, odd)], "c string, q string").select(T.prompt(F.col("c"), F.col("q"))).first()[0]
    assert got.count(odd) == 2 and got.endswith(T.PROMPT_END)


def test_label_and_words(spark):
    rows = spark.createDataFrame([("f", 0, "t"), (None, None, "t")], "f string, p int, t string")
    assert [r[0] for r in rows.select(T.label(F.col("f"), F.col("p"), F.col("t"))).collect()] == ["[f, page 0]\nt", "[unknown, page ?]\nt"]
    assert rows.select(T.words(F.lit("  a \n b "))).first()[0] == ["a", "b"]

"""Templates and chains of stages."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.template import Template
from tessera.operators import models
from tessera.operators.stages import expression, field, lifted, passed, record, table
from tessera.plans.answer import answer, chain
from tessera.plans.ingest import ingest
from tessera.operators.store import ChunkStore
from tessera.settings import Settings


@pytest.mark.parametrize("text", ["{}", "{0}", "{a.b}", "{a[0]}", "{a!r}", "{a:>3}", "{a", "a}", "{ a }"])
def test_templates_that_are_wrong(text):
    with pytest.raises(ValueError):
        Template(text)


def test_templates(spark):
    t = Template("{{{a}}} $1 \\1 {b}{a}\n{{a}}")
    assert t.slots == ["a", "b"] and t.between("b") == ("} $1 \\1 ", "") and t.between("a") == ("{", "} $1 \\1 ")
    values = {"a": "{b} $2 \\ }{", "b": "{{a}}"}
    filled = t.fill(**values)
    assert filled == "{" + values["a"] + "} $1 \\1 " + values["b"] + values["a"] + "\n{a}"
    rows = spark.createDataFrame([(values["a"], values["b"]), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(t.column(a=F.col("a"), b=F.col("b"))).collect()] == [filled, "{} $1 \\1 x\n{a}"]
    assert spark.range(1).select(Template("").column()).first()[0] == ""
    for more in ({"a": F.lit(1)}, {"a": F.lit(1), "b": F.lit(1), "c": F.lit(1)}):
        with pytest.raises(ValueError, match="slot"):
            t.column(**more)


def shout(x: str) -> str:
    return x + "!"


def count(x: str) -> "int":
    return len(x)


def test_chains(spark):
    rows = spark.createDataFrame([(1, " ab "), (2, "c")], "id int, q string")
    chain_ = record(loud=passed() | shout, n=count, whole=passed()) | Template("{loud}{n}") | expression(T.strip) | lifted(lambda x: x * 2, "string")
    out = chain_.over(rows, "q", "answer")
    assert out.columns == ["id", "q", "answer"]
    assert [r["answer"] for r in out.orderBy("id").collect()] == ["ab !4ab !4", "c!1c!1"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the branches' functions side by side, the last one: no more passes than there are steps
    with pytest.raises(TypeError):
        passed() | (lambda x: x)
    with pytest.raises(ValueError, match="slot"):
        (record(a=passed()) | Template("{a}{b}")).over(rows, "q")
    nested = record(x=record(y=passed() | shout) | field("y"), z=table(lambda r, c, n: r.withColumn(n, F.length(c)))) | expression(lambda c: F.to_json(c))
    assert [r["value"] for r in nested.over(rows, "q").orderBy("id").collect()] == ['{"x":" ab !","z":4}', '{"x":"c!","z":1}']


def test_answers_by_another_template(spark, tmp_path):
    template = "Q {question}\nC <{context}> {{end}}"
    s, e = Settings(store_path=str(tmp_path / "store"), embed_dim=16, store_buckets=2, prompt_template=template), models.HashingEmbedder(16)
    ingest(spark, spark.createDataFrame([("f", 0, "red fox\nof {question}"), ("f", 1, "blue sky")], "source_file string, page int, page_content string"), s, e)
    store = ChunkStore(spark, s.store_path, s.collection).read()
    asked = spark.createDataFrame([(1, " red fox "), (2, "blue sky")], "qid long, question string")
    got = {r["qid"]: r for r in answer(store, asked, 1, e, models.FirstLineGenerator(template), template).collect()}
    assert got[1]["prompt"] == "Q red fox\nC <[f, page 0]\nred fox\nof {question}> {end}"
    assert got[1]["answer"] == "red fox" and got[2]["answer"] == "blue sky"
    whole = chain(store, 1, e, models.FirstLineGenerator(template), template).over(asked, "question", "answer").collect()
    assert {r["qid"]: r["answer"] for r in whole} == {1: "red fox", 2: "blue sky"}
    with pytest.raises(ValueError, match="PROMPT_TEMPLATE"):
        Settings(prompt_template="{other}")
    assert models.FirstLineGenerator("{context}").generate(["[f]\nx"])[0].endswith("\nx\n")

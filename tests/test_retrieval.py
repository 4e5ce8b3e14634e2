import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_distance
from tessera.operators.answering import contexts
from tessera.operators.retrieval import ordered, top_batch, top_single
from tessera.plans import catalogue

SCHEMA = "id string, embedding array<float>"


def rows(spark):
    return spark.createDataFrame([("c", [1.0, 0.0]), ("a", [2.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], SCHEMA)


def test_single_and_batch_agree(spark):
    single = [(r["id"], r["rank"], r["distance"]) for r in top_single(rows(spark), [1.0, 0.0], 9).orderBy("rank").collect()]
    assert [x[:2] for x in single] == [("a", 1), ("c", 2), ("b", 3), ("n", 4), ("z", 5)] and single[3][2] is None and abs(single[2][2] - 1) < 1e-12
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "qid long, vector array<double>")
    got = top_batch(rows(spark), asked, 9, block=1)
    assert [(r["id"], r["rank"], r["distance"]) for r in got.filter("qid = 1").orderBy("rank").collect()] == single
    assert [r["id"] for r in got.filter("qid = 2 AND rank <= 2").orderBy("rank").collect()] == ["b", "a"]


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(7, 8))
    store = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vector array<double>")
    got = {(r["qid"], r["rank"]): r["id"] for r in top_batch(store, asked, 4, block=3).collect()}
    d = 1 - (v.astype(float) @ q.T) / np.outer(np.linalg.norm(v.astype(float), axis=1), np.linalg.norm(q, axis=1))
    assert got == {(j, k + 1): f"{i:03}" for j in range(7) for k, i in enumerate(np.argsort(d[:, j], kind="stable")[:4])}


def test_wrong_length_and_empty(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, vector array<double>")
    with pytest.raises(PySparkException):
        top_batch(rows(spark), asked, 2).collect()
    with pytest.raises(PySparkException):
        rows(spark).select(cosine_distance(F.col("embedding"), F.array(F.lit(1.0)))).collect()
    assert top_batch(rows(spark), asked.limit(0), 2).count() == 0
    none = top_batch(rows(spark).limit(0), asked, 2)
    found = contexts(none.withColumn("source_file", F.lit("f")).withColumn("page", F.lit(1)).withColumn("document", F.lit("t")), asked)
    assert [(r["qid"], r["context"]) for r in found.collect()] == [(1, "")]


def test_all_rows_in_order(spark):
    """Ties, null distances, a question without a vector and one without a number: as top_batch() has them for a k past the store."""
    rng = np.random.default_rng(4)
    stored = [(f"{i:03}", x) for i, x in enumerate(rng.normal(size=(150, 4)).tolist())] + [(f"t{i}", [1.0, 2.0, 3.0, 4.0]) for i in range(9)] + [("z", [0.0] * 4), ("n", None)]
    store = spark.createDataFrame(stored, SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(5, 4)).tolist())] + [(8, [1.0, 2.0, 3.0, 4.0]), (9, None), (None, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<double>")
    got, want = (sorted(map(repr, x.select("qid", "rank", "id", "distance").collect())) for x in (ordered(store, asked), top_batch(store, asked, 200)))
    assert got == want and len(got) == 161 * 8
    assert ordered(store.limit(0), asked).count() == 0 == ordered(store, asked.limit(0)).count()


def test_topk_short_gives_all_of_its_collection(spark, tmp_path):
    """Every row of collection 0 for every question, and every question for the collection without rows."""
    rng = np.random.default_rng(7)
    vectors = [(i, x, i % 3) for i, x in enumerate(rng.normal(size=(60, catalogue.DIM)).tolist())]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"who is number {i}") for i in range(4)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalogue.topk_short(spark, str(tmp_path)).collect()
    for q in range(4):
        own = [(r["rank"], r["id"]) for r in got if r["qid"] == q and r["collection"] == 0]
        assert sorted(r for r, _ in own) == list(range(1, 21)) and {i for _, i in own} == set(range(0, 60, 3))
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got if r["collection"] == -1) == [(q, None, None) for q in range(4)]

import re

import numpy as np
import pytest

from tessera.operators import retrieval
from tessera.operators.blocks import packed
from tessera.operators.pivots import PivotIndex, farthest_first, units
from tessera.operators.retrieval import top_batch, top_by_key

SCHEMA, ASKED = "id string, embedding array<float>", "qid long, vector array<double>"


def plain(df):
    return sorted((r["qid"], r["rank"], r["id"], None if r["distance"] is None else round(r["distance"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 12 centres, one of which has a third of all, a vector that many rows repeat, zero and null vectors."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    at = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 12, 3000))
    v = (centres[at] + 0.05 * rng.normal(size=(3000, 24))).astype(np.float32)
    v[500:900] = v[500]
    rows = [(f"{i:05}", x.tolist()) for i, x in enumerate(v)] + [("zero", [0.0] * 24), ("null", None), ("nan", [float("nan")] * 24)]
    asked = [(i, (centres[i % 12] + 0.1 * rng.normal(size=24)).tolist()) for i in range(30)] + [(40, v[500].astype(float).tolist()), (41, [0.0] * 24)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(asked, ASKED)


def test_same_as_all_rows_and_fewer_visited(spark, clustered, tmp_path):
    store, asked = clustered
    index = PivotIndex(spark, str(tmp_path / "index")).build(store, pivots=32, shell=64)
    found, visits = index.search(asked, 7)
    assert plain(found) == plain(top_batch(store, asked, 7))
    rows = {r["qid"]: r["rows"] for r in visits.collect()}
    assert rows.pop(41) == store.count()  # no distances, no bounds
    assert sum(rows.values()) / (len(rows) * store.count()) < 0.2
    index.discard()
    assert not (tmp_path / "index").exists()


def test_more_than_there_are_ties_and_empty_tables(spark, clustered, tmp_path):
    store, asked = clustered
    few = store.filter("id < '00012' OR id >= 'a'")
    index = PivotIndex(spark, str(tmp_path / "few")).build(few, shell=4)
    found, _ = index.search(asked.filter("qid < 3"), 20)
    assert plain(found) == plain(top_batch(few, asked.filter("qid < 3"), 20)) and found.count() == 3 * few.count()
    ties, _ = PivotIndex(spark, str(tmp_path / "ties")).build(store.filter("id >= '00500' AND id < '00900'"), shell=16).search(asked.filter("qid = 40"), 5)
    assert [r["id"] for r in ties.orderBy("rank").collect()] == [f"{i:05}" for i in range(500, 505)]
    assert index.search(asked.limit(0), 3)[0].count() == 0
    assert PivotIndex(spark, str(tmp_path / "none")).build(store.limit(0)).search(asked, 3)[0].count() == 0


def test_random_vectors_lose_nothing(spark, tmp_path):
    rng = np.random.default_rng(7)
    store = spark.createDataFrame([(f"{i:04}", x.tolist()) for i, x in enumerate(rng.normal(size=(600, 6)))], SCHEMA)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(25, 6)))], ASKED)
    found, visits = PivotIndex(spark, str(tmp_path / "i")).build(store, pivots=20, shell=16).search(asked, 4)
    assert plain(found) == plain(top_batch(store, asked, 4))
    assert sum(r["rows"] for r in visits.collect()) < 25 * 600


def test_farthest_first():
    v, valid = units(np.array([[2.0, 0], [0, 1], [-1, 0], [1, 0], [0, 0], [np.nan, 1]]))
    assert valid.tolist() == [True, True, True, True, False, False]
    assert farthest_first(v[valid], 9).tolist() == [[1, 0], [-1, 0], [0, 1]]


def test_blocks_of_one_key(spark):
    rows = spark.createDataFrame([(i, [float(i)], k) for i, k in enumerate([None, None, "a", "a", "a", "b"])], "id int, v array<double>, k string").coalesce(1)
    got = [(r["key"], r["ids"]) for r in packed(rows, "id", "v", 2, "k").collect()]
    assert got == [(None, [0, 1]), ("a", [2, 3]), ("a", [4]), ("b", [5])]


def test_each_question_in_its_own_collection(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"{i:03}", x.tolist(), [None, "a", "b", "b", "b"][i % 5]) for i, x in enumerate(rng.normal(size=(120, 5)))]
    store = spark.createDataFrame(rows, SCHEMA + ", collection string").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist(), ["a", "b", "none", None][i % 4]) for i, x in enumerate(rng.normal(size=(9, 5)))], ASKED + ", collection string")
    got = plain(top_by_key(store, asked, 3, block=2))
    want = [r for c in ("a", "b") for r in plain(top_batch(store.filter(f"collection = '{c}'"), asked.filter(f"collection = '{c}'"), 3))]
    assert got == sorted(want) and len(got) == 15
    monkeypatch.setattr(retrieval, "FEW", 1)
    assert plain(top_by_key(store, asked, 3)) == got
    assert plain(top_by_key(store, asked.limit(0), 3)) == plain(top_by_key(store.limit(0), asked, 3)) == []


def test_only_asked_collections_are_read(spark, tmp_path):
    store = spark.createDataFrame([(f"{i}", [float(i), 1.0], f"c{i % 9}") for i in range(90)], SCHEMA + ", collection string")
    store.write.partitionBy("collection").parquet(str(tmp_path / "store"))
    asked = spark.createDataFrame([(1, [1.0, 0.0], "c3"), (2, [1.0, 2.0], "c5")], ASKED + ", collection string")
    found = top_by_key(spark.read.schema(store.schema).parquet(str(tmp_path / "store")), asked, 2)
    assert len(plain(found)) == 4
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", found._jdf.queryExecution().executedPlan().toString())[1]
    assert set(re.findall(r"\bc\d\b", filters)) == {"c3", "c5"}

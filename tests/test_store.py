"""Versions of a bucketed table, vectors by content, metadata."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import models
from tessera.operators.buckets import BucketTable, Conflict
from tessera.operators.store import ChunkStore
from tessera.plans import catalogue
from tessera.plans.ingest import ingest
from tessera.settings import Settings

SCHEMA = "id string, document string"


def files(table):
    """Bucket -> its data files with the times of their last change."""
    found = {}
    for f in Path(table.at).glob("data/*/bucket=*/*.parquet"):
        found.setdefault(int(f.parent.name[7:]), set()).add((str(f), f.stat().st_mtime_ns))
    return found


def rows(spark, ids, text):
    return spark.createDataFrame([(i, f"{text} {i}") for i in ids], SCHEMA)


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_upsert_rewrites_only_the_buckets_of_its_ids(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, buckets=64, keep=0)
    ids = [f"id-{i}" for i in range(1000)]
    assert table.upsert(rows(spark, ids, "old")) == 1
    before = files(table)
    some = ids[::100]  # a hundredth of them
    assert table.upsert(rows(spark, [*some, "new"], "new")) == 2
    after, touched = files(table), set(table.touched(rows(spark, [*some, "new"], "")))
    assert len(touched) <= 11 and set(before) == set(after) and {b for b in before if before[b] != after[b]} == touched
    assert held(table.read()) == sorted([(i, f"new {i}" if i in some else f"old {i}") for i in ids] + [("new", "new new")])
    assert table.upsert(rows(spark, [], "")) == 2 and table.versions() == [2]
    table.delete(rows(spark, ["new", "absent", *ids[1:]], ""))
    assert held(table.read()) == [("id-0", "new id-0")] and len(files(table)) == 1
    assert held(table.read(buckets=[b for b in range(64) if b not in files(table)])) == []
    table.reset_to(rows(spark, [], ""))
    assert held(table.read()) == [] and files(table) == {}


def test_repeated_upsert_and_changes(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4, keep=3)
    table.upsert(rows(spark, ["a", "b", "c", "d", "e"], "x"))
    table.upsert(rows(spark, ["a", "b", "f"], "y").unionByName(rows(spark, ["c"], "x")))
    once = held(table.read())
    table.upsert(rows(spark, ["a", "b", "f"], "y"))
    assert held(table.read()) == once
    total = table.changes(1, 2).agg(*(F.sum(c) for c in ("replaced", "added", "removed"))).first()
    assert tuple(total) == (2, 1, 0)
    assert all(r["replaced"] == r["added"] == r["removed"] == 0 for r in table.changes(2, 3).collect()) and table.changes(3, 3).count() == 0


def test_readers_keep_their_version(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2, keep=0)
    table.upsert(rows(spark, ["a", "b", "c"], "x"))
    with table.pinned() as version:
        old = table.read(version)
        for text in ("y", "z"):
            table.upsert(rows(spark, ["a", "b", "c"], text))
        assert held(old) == [(i, f"x {i}") for i in "abc"] == held(table.read(version))
        assert table.versions() == [1, 3]
    table.upsert(rows(spark, ["a"], "w"))
    assert table.versions() == [4] and not list(Path(table.at).glob("pins/*"))
    table.keep, late = 1, table.read()
    table.upsert(rows(spark, ["a"], "v"))
    assert held(late)[0] == ("a", "w a")  # one older version stays without a pin


def test_writers_of_other_buckets_both_succeed(spark, tmp_path):
    table, other = (BucketTable(spark, str(tmp_path / "t"), SCHEMA, buckets=16) for _ in range(2))
    table.upsert(rows(spark, ["a", "b"], "x"))
    assert len(table.touched(rows(spark, ["a", "b"], ""))) == 2
    base = table.manifest()
    other.upsert(rows(spark, ["b"], "y"))
    bucket = table.touched(rows(spark, ["a"], ""), base)
    table._put(base, rows(spark, ["a"], "z"), bucket)
    assert held(table.read()) == [("a", "z a"), ("b", "y b")] and table.versions()[-1] == 3
    with pytest.raises(Conflict):
        table._put(base, rows(spark, ["a"], "w"), bucket)
    assert held(table.read()) == [("a", "z a"), ("b", "y b")]
    live = set(table.manifest()["files"].values()) | set(table.manifest(2)["files"].values())
    assert {p.name for p in Path(table.at).glob("data/*")} == live  # what the loser wrote is gone
    assert not table._publish(table.manifest())


class Counting(models.HashingEmbedder):
    """Writes down what it embeds; tasks are processes of their own."""

    def __init__(self, dim, log):
        super().__init__(dim)
        self.log = str(log)

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return super().embed(texts)


def test_a_new_first_page_costs_one_page(spark, tmp_path):
    s, log = Settings(store_path=str(tmp_path / "store"), embed_dim=4, chunk_size=30, chunk_overlap=0, store_buckets=4), tmp_path / "log"

    def embedded(*texts, **more):
        log.write_text("")
        ingest(spark, spark.createDataFrame([("f", p, t) for p, t in enumerate(texts)], "source_file string, page int, page_content string"), s, Counting(4, log), **more)
        return sorted(log.read_text().splitlines())

    pages = [f"this is page {p}" for p in range(20)]
    assert embedded(*pages) == sorted(pages)
    assert embedded("a first page", *pages) == ["a first page"]  # all ids after it are new, their texts aren't
    assert embedded("a first page", *pages, "a first page", clean=True) == [] and embedded(*pages, reset=True) == []
    stored = ChunkStore(spark, s.store_path, s.collection).read().orderBy("chunk_index").collect()
    assert [r["document"] for r in stored] == pages and all(list(r["embedding"]) == Counting(4, log).embed([r["document"]])[0] for r in stored)
    assert len(ingest(spark, spark.createDataFrame([], "source_file string, page int, page_content string"), s, Counting(4, log)).collect()) == 0
    assert not list((tmp_path / "store").glob("**/stage-*"))


def test_progress_while_the_ingest_goes_on(spark, tmp_path):
    s, said = Settings(store_path=str(tmp_path / "store"), embed_dim=4, chunk_size=8, chunk_overlap=0, store_buckets=2), []
    pages = spark.createDataFrame([("f", 0, "aaa bbb ccc"), ("f", 1, " "), ("g", 0, "ccc")], "source_file string, page int, page_content string")
    for _ in range(2):
        report = ingest(spark, pages, s, models.HashingEmbedder(4), progress=lambda step, counts: said.append((step, counts)))
    split = ("split", {"pages": 3, "chunks": 3, "blank": 1})
    assert said == [split, ("new", {"chunks": 3}), ("embedded", {"texts": 2}), ("stored", {"version": 1}), split, ("new", {"chunks": 0}), ("embedded", {"texts": 0}), ("stored", {"version": 1})]
    assert sorted(tuple(r) for r in report.collect()) == [("f", 2, 2), ("g", 1, 1)]
    said.clear()
    none = pages.limit(0)
    ingest(spark, none, s, models.HashingEmbedder(4), progress=lambda step, counts: said.append((step, counts)))
    assert said[0] == ("split", {"pages": 0, "chunks": 0, "blank": 0})


@pytest.mark.parametrize("kind", ["string", "variant"])
def test_metadata_from_page_to_label(spark, tmp_path, kind):
    s = Settings(store_path=str(tmp_path / "store"), embed_dim=4, store_buckets=4)
    given = ['{"producer": "p", "own": {"deep": [1, 2]}, "n": 3}', None, "{}"]
    table = spark.createDataFrame([("f", p, f"page {p}", m) for p, m in enumerate(given)], "source_file string, page int, page_content string, metadata string")
    table = table.withColumn("metadata", F.parse_json("metadata")) if kind == "variant" else table
    for how in ({}, {}, {"reset": True}, {"clean": True}):
        ingest(spark, table, s, models.HashingEmbedder(4), **how)
        stored = ChunkStore(spark, s.store_path, s.collection).read().orderBy("page")
        own = F.try_variant_get("metadata", "$.own.deep[1]", "int")
        got = stored.select(T.meta(F.col("metadata"), "producer", "unknown"), T.meta(F.col("metadata"), "n", "?"), own, F.to_json("metadata").isNull()).collect()
        assert [tuple(r) for r in got] == [("p", "3", 2, False), ("unknown", "?", None, True), ("unknown", "?", None, False)]


def test_reuse_embeds_each_text_once(spark, tmp_path, monkeypatch):
    """However often an upsert reads what comes in, and however many rows have a text."""
    log = str(tmp_path / "embedded")

    class Told(models.HashingEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return super().embed(texts)

    monkeypatch.setattr(catalogue, "HashingEmbedder", Told)
    docs = [(i, f"text {i % 7}", "en" if i < 4 else "de", f"s{i % 2}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert held(catalogue.embed_reuse(spark, str(tmp_path))) == [("s0", 10, 3), ("s1", 10, 3)]
    with open(log) as f:
        assert sorted(f.read().splitlines()) == [f"text {i}" for i in range(7)]


def test_hashed_vectors_count_words():
    words = ["a", "b", "a", "c", "a"]
    plain = [0.0] * 3
    for w in words:
        plain[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 3] += 1.0
    assert models.HashingEmbedder(3).embed([" ".join(words), ""]) == [plain, [0.0] * 3]

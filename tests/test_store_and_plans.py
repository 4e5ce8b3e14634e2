import pytest

from tessera import cli
from tessera.operators import models
from tessera.operators.answering import asked_questions, missing_models
from tessera.operators.store import ChunkStore
from tessera.plans.answer import answer
from tessera.plans.ingest import identified, ingest
from tessera.settings import Settings, read_dotenv
from tessera.sources.pdf import NoSource, pdf_files, require_files
from tessera.streaming.reingest import follow

PAGES = "source_file string, page int, page_content string"


def setup(tmp_path, **more):
    return Settings(store_path=str(tmp_path / "store"), embed_dim=16, chunk_size=8, chunk_overlap=0, **more)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES)


def held(spark, s):
    return sorted((r["source_file"], r["chunk_index"], r["document"]) for r in ChunkStore(spark, s.store_path, s.collection).read().collect())


def test_ingest_twice_edit_clean_reset(spark, tmp_path):
    s, e = setup(tmp_path), models.HashingEmbedder(16)
    first = pages(spark, ("f", 0, "aaa bbb ccc"), ("f", 1, " "), ("g", 0, "  "))
    report = {r["source_file"]: (r["pages"], r["chunks"]) for r in ingest(spark, first, s, e).collect()}
    assert report == {"f": (2, 2), "g": (1, 0)}
    once = held(spark, s)
    ingest(spark, first, s, e)
    assert held(spark, s) == once == [("f", 0, "aaa bbb"), ("f", 1, "ccc")]
    edited = pages(spark, ("f", 0, "zzz aaa bbb ccc"))
    ingest(spark, edited, s, e)
    assert len(held(spark, s)) == 4  # the edit's chunks are new, the old ones stay
    ingest(spark, edited, s, e, clean=True)
    assert held(spark, s) == [("f", 0, "zzz aaa"), ("f", 1, "bbb ccc")]
    ingest(spark, first, s, e, reset=True)
    assert held(spark, s) == once


def test_ids_do_not_depend_on_row_order(spark, tmp_path):
    s = setup(tmp_path)
    rows = [("f", p, "aaa bbb ccc ddd") for p in range(6)] + [("g", 0, "x")]
    ids = [sorted(r["id"] for r in identified(pages(spark, *x).repartition(n), s).collect()) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])


def test_known_chunks_are_not_embedded_again(spark, tmp_path):
    s = setup(tmp_path)
    ingest(spark, pages(spark, ("f", 0, "aaa")), s, models.HashingEmbedder(16))

    class Failing(models.HashingEmbedder):
        def embed(self, texts):
            raise AssertionError("nothing is new")

    ingest(spark, pages(spark, ("f", 0, "aaa")), s, Failing(16))
    other = Failing(16)
    other.name = "another model"
    with pytest.raises(Exception, match="nothing is new"):
        ingest(spark, pages(spark, ("f", 0, "aaa")), s, other)
    assert held(spark, s) == [("f", 0, "aaa")]  # the failed attempt left the store as it was


def test_repeated_ids_and_collections(spark, tmp_path):
    a, b = ChunkStore(spark, str(tmp_path), "a"), ChunkStore(spark, str(tmp_path), "b")
    row = ("i", "one", "f", 0, 0, "m", [1.0])
    schema = "id string, document string, source_file string, page int, chunk_index int, model string, embedding array<float>"
    a.upsert(spark.createDataFrame([row, ("i", "two", *row[2:])], schema))
    b.upsert(spark.createDataFrame([row], schema))
    assert [r["document"] for r in a.read().collect()] == ["two"] and [r["document"] for r in b.read().collect()] == ["one"]
    a.reset_to(spark.createDataFrame([], schema))
    assert a.read().count() == 0 and b.read().count() == 1 and ChunkStore(spark, str(tmp_path), "c").read().count() == 0


def test_answers(spark, tmp_path):
    s, e = setup(tmp_path), models.HashingEmbedder(16)
    ingest(spark, pages(spark, ("f", 0, "red fox"), ("f", 1, "blue sky")), s, e)
    asked = spark.createDataFrame([(1, "  blue sky \n"), (2, "red fox")], "qid long, question string")
    store = ChunkStore(spark, s.store_path, s.collection).read()
    got = {r["qid"]: r for r in answer(store, asked, 2, e, models.FirstLineGenerator()).collect()}
    assert got[1]["answer"] == "blue sky" and got[2]["answer"] == "red fox"
    assert got[1]["context"] == "[f, page 1]\nblue sky\n\n[f, page 0]\nred fox"
    none = answer(store.limit(0), asked, 2, e, models.FirstLineGenerator()).collect()
    assert [r["context"] for r in none] == ["", ""] and none[0]["answer"].startswith("The context")


def test_sessions(spark):
    lines = [(1, 0, " a "), (1, 1, "\u00a0"), (1, 2, "Exit\n"), (1, 3, "b"), (2, 0, "quit it"), (3, 5, "c")]
    got = asked_questions(spark.createDataFrame(lines, "s int, n int, text string"), "s", "n").collect()
    assert sorted((r["s"], r["n"], r["question"]) for r in got) == [(1, 0, "a"), (2, 0, "quit it"), (3, 5, "c")]


@pytest.mark.parametrize(("have", "missing"), [("m:latest", False), ("mx:latest", True), ("m", False)])
def test_models(spark, have, missing):
    needed = spark.createDataFrame([("m", 0)], "model string, priority int")
    assert (missing_models(needed, spark.createDataFrame([(have,)], "name string")).count() == 1) == missing
    s = Settings(embed_model="m", chat_model="absent")
    if missing:
        with pytest.raises(models.ModelError, match="'m'"):
            models.preflight(s, chat=False, have={have})
    else:
        models.preflight(s, chat=False, have={have})
        with pytest.raises(models.ModelError, match="'absent'"):
            models.preflight(s, have={have})


def test_models_of_many_servers(spark):
    installed = spark.createDataFrame([("a", "m:1:q4"), ("a", "n"), ("b", "mx"), ("b", "n_"), ("c", None)], "server string, name string")
    needed = spark.createDataFrame([(s, m) for s in "abcd" for m in ("m", "m:1", "m:1:q4", "m:1:q", "n", "n:")], "server string, model string")
    got = {(r["server"], r["model"]) for r in missing_models(needed, installed, "server").collect()}
    assert got == {(s, m) for s in "abcd" for m in ("m", "m:1", "m:1:q4", "m:1:q", "n", "n:")} - {("a", m) for m in ("m", "m:1", "m:1:q4", "n")}
    plan = missing_models(needed, installed, "server")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unreachable_server(capsys, monkeypatch):
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://127.0.0.1:9")
    assert cli.main(["ask", "x"]) == 1 and "No model server" in capsys.readouterr().err


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nTOP_K=7\nexport CHUNK_SIZE='99'\nCHUNK_OVERLAP=9\n")
    s = Settings.load({"TOP_K": "3"}, tmp_path / ".env")
    assert (s.top_k, s.chunk_size, s.chunk_overlap, s.embed_dim) == (3, 99, 9, 768)
    assert read_dotenv(tmp_path / "none") == {}
    with pytest.raises(ValueError):
        Settings.load({"TOP_K": ""}, None)
    with pytest.raises(ValueError):
        Settings(chunk_size=5, chunk_overlap=6)


def test_listing(spark, tmp_path):
    with pytest.raises(NoSource):
        require_files(pdf_files(spark, str(tmp_path)), str(tmp_path))
    for name in ("b.pdf", "a.pdf", "B.PDF", ".h.pdf", "_u.pdf", "x.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in pdf_files(spark, str(tmp_path)).collect()) == ["a.pdf", "b.pdf"]


def test_empty_folder_leaves_the_store(spark, tmp_path, monkeypatch, capsys):
    s = setup(tmp_path)
    ingest(spark, pages(spark, ("f", 0, "aaa")), s, models.HashingEmbedder(16))
    (tmp_path / "pdfs").mkdir()
    monkeypatch.setenv("PDF_DIR", str(tmp_path / "pdfs"))
    monkeypatch.setenv("STORE_PATH", s.store_path)
    assert cli.main(["--offline", "ingest", "--reset"]) == 1 and held(spark, s) == [("f", 0, "aaa")]


def test_cli_questions(spark, tmp_path):
    s = setup(tmp_path)
    ingest(spark, pages(spark, ("f", 0, "red fox")), s, models.HashingEmbedder(16))
    said, lines = [], iter(["  ", "red fox", "EXIT"])
    cli.run_ask(s, [], True, said.append, lambda _: next(lines))
    assert said[1:] == ["red fox"]
    cli.run_ask(s, ["red", "fox"], True, said.append)
    assert said[-1] == "red fox"


def test_stream(spark, tmp_path):
    s = setup(tmp_path)
    for batch in ([("f", 0, "aaa bbb ccc")], [("g", 0, "ddd")]):
        pages(spark, *batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), str(tmp_path / "ck"), s, models.HashingEmbedder(16), once=True).awaitTermination()
    assert [x[2] for x in held(spark, s)] == ["aaa bbb", "ccc", "ddd"]

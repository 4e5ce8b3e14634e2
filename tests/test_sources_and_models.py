"""PDF pages with a stand-in for the parser, and model backends against a local server."""

import json

import threading

from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera import cli
from tessera.operators import models
from tessera.operators.store import ChunkStore, Conflict
from tessera.plans.ingest import ingest
from tessera.settings import Settings
from tessera.sources.pdf import pdf_files, pdf_pages

PARSER = """
class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        return self.text


class PdfReader:
    def __init__(self, stream):
        data = stream.read().decode()
        if data.startswith("broken"):
            raise ValueError("not a PDF")
        self.pages = [Page(t or None) for t in data.split("\\f")]
"""


@pytest.fixture()
def parser(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "pypdf.py").write_text(PARSER)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "pypdf.py"))
    return tmp_path


def test_pdf_pages_in_order_with_blank_ones_and_errors(spark, parser):
    folder = parser / "pdfs"
    folder.mkdir()
    (folder / "b.pdf").write_text("one\f\ftwo words")
    (folder / "a.pdf").write_text("only")
    (folder / "c.txt").write_text("no")
    got = sorted(tuple(r) for r in pdf_pages(pdf_files(spark, str(folder))).collect())
    assert got == [("a.pdf", 0, "only"), ("b.pdf", 0, "one"), ("b.pdf", 1, ""), ("b.pdf", 2, "two words")]
    s = Settings(pdf_dir=str(folder), store_path=str(parser / "store"), embed_dim=16)
    report = {r["source_file"]: (r["pages"], r["chunks"]) for r in ingest(spark, pdf_pages(pdf_files(spark, str(folder))), s, models.HashingEmbedder(16)).collect()}
    assert report == {"a.pdf": (1, 1), "b.pdf": (3, 2)}
    (folder / "d.pdf").write_text("broken")
    with pytest.raises(Exception, match="not a PDF"):
        ingest(spark, pdf_pages(pdf_files(spark, str(folder))), s, models.HashingEmbedder(16))
    assert ChunkStore(spark, s.store_path, s.collection).read().count() == 3


@pytest.fixture()
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.reply({"models": [{"name": "embed:latest"}, {"name": "chat:1b"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path == "/api/embed":
                self.reply({"embeddings": [[float(len(t)), 1.0] for t in body["input"]]})
            else:
                self.reply({"response": f"<think>hm</think> {len(body['prompt'])} read "})

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_backends_over_http(spark, server, tmp_path, monkeypatch):
    url, seen = server
    s = Settings(base_url=url, embed_model="embed", chat_model="chat", embed_dim=2, store_path=str(tmp_path / "store"), batch_size=2)
    models.preflight(s)
    with pytest.raises(models.ModelError, match="other"):
        models.preflight(Settings(base_url=url, embed_model="embed", chat_model="other"))
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 6)] + [(9, None)], "i int, chunk string").coalesce(1)
    got = {r["i"]: r["embedding"] for r in models.with_embeddings(rows, models.HttpEmbedder(s), batch=s.batch_size).collect()}
    assert got == {i: [float(i), 1.0] for i in range(1, 6)} | {9: None}
    assert sorted(len(b["input"]) for p, b in seen) == [1, 2, 2] and {b["model"] for _, b in seen} == {"embed"}
    ingest(spark, spark.createDataFrame([("f", 0, "some words")], "source_file string, page int, page_content string"), s, models.HttpEmbedder(s))
    said = []
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.run_ask(s, ["what", "words?"], False, said.append)
    path, body = seen[-1]
    assert path == "/api/generate" and "some words" in body["prompt"] and body["options"] == {"temperature": s.temperature, "num_ctx": s.num_ctx}
    assert said == [f"{len(body['prompt'])} read"]


def test_each_new_chunk_is_embedded_once(spark, tmp_path):
    """Over a store that holds chunks already, with and without clean; counted in a file, as tasks are processes of their own."""
    s, log = Settings(store_path=str(tmp_path / "store"), embed_dim=4, chunk_size=20, chunk_overlap=0), str(tmp_path / "log")

    class Counting(models.HashingEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return super().embed(texts)

    def embedded(name, clean):
        open(log, "w").close()
        pages = spark.createDataFrame([(f"{name}{i}", p, f"page {p} of {name}{i}") for i in range(5) for p in range(6)], "source_file string, page int, page_content string")
        report = ingest(spark, pages, s, Counting(4), clean=clean)
        assert {r["chunks"] for r in report.collect()} == {6}
        return sorted(open(log).read().splitlines())

    for name, clean in (("a", False), ("b", False), ("c", True)):
        assert embedded(name, clean) == sorted(f"page {p} of {name}{i}" for i in range(5) for p in range(6))
    assert embedded("c", True) == []
    assert not list((tmp_path / "store").glob("**/stage-*"))


def test_the_second_of_two_writers_fails(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), "c")
    row = spark.createDataFrame([("i", "d", "f", 0, 0, "m", [1.0])], "id string, document string, source_file string, page int, chunk_index int, model string, embedding array<float>")

    def meanwhile(rows):
        ChunkStore(spark, str(tmp_path), "c").upsert(row)
        return row

    with pytest.raises(Conflict):
        store._write(meanwhile)
    assert store.read().count() == 1 and store.snapshots() == [1]



import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking
from tessera.operators.chunking import chunk_pages, indexed, register, split_pages, split_text
from tessera.plans import catalogue

CASES = [
    ("aaa\n\nbbb\n\nccc", 8, 0, ["aaa\n\nbbb", "ccc"]),
    ("a\n\n\nb", 3, 0, ["a", "b"]),
    ("one two\nthree four", 9, 4, ["one two", "three", "four"]),
    ("aaa bbb ccc ddd", 7, 3, ["aaa bbb", "ccc", "ddd"]),
    ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
    ("   ", 5, 0, []),
    ("éé😀😀 xx", 5, 0, ["éé😀😀", "xx"]),
    (None, 5, 0, []),
    ("", 5, 0, []),
    ("whole", 1200, 200, ["whole"]),
]


@pytest.mark.parametrize(("text", "size", "overlap", "want"), CASES)
def test_hand_made(text, size, overlap, want):
    assert list(split_text(text, size, overlap)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té😀", max_size=60), st.integers(2, 12), st.integers(0, 12))
def test_properties(text, size, overlap):
    chunks = list(split_text(text, size, min(overlap, size)))
    assert all(len(c) <= size and c == c.strip() and c and c in text for c in chunks)
    if len(text) <= size and len(text) > 0:
        assert len(chunks) >= bool(text.strip())
    if not text.strip():
        assert chunks == []
    kept = [c for c in text if not c.isspace()]
    assert not set(kept) - set("".join(chunks))


def test_short_text_is_one_chunk():
    assert list(split_text(" a b\nc ", 20, 5)) == ["a b\nc"]


def test_pages_udtf_and_index(spark):
    pages = spark.createDataFrame([("f", 0, "aaa bbb ccc"), ("f", 1, None), ("f", 2, "ddd eee"), ("g", 0, " "), (None, 0, "x")], "source_file string, page int, page_content string")
    chunks = chunk_pages(pages, 7, 0)
    rows = {(r["source_file"], r["page"], r["pos"]): r for r in indexed(chunks).collect()}
    assert {k: (r["chunk"], r["chunk_index"]) for k, r in rows.items()} == {("f", 0, 0): ("aaa bbb", 0), ("f", 0, 1): ("ccc", 1), ("f", 2, 0): ("ddd eee", 2), (None, 0, 0): ("x", 0)}
    register(spark)
    pages.createOrReplaceTempView("pages_in")
    got = spark.sql("SELECT source_file, page, c.pos, c.chunk FROM pages_in, LATERAL split_text(page_content, 7, 0) c").collect()
    assert {(r["source_file"], r["page"], r["pos"], r["chunk"]) for r in got} == {(*k, r["chunk"]) for k, r in rows.items()}
    assert indexed(chunk_pages(pages.limit(0), 7, 0)).count() == 0


def batches_of(monkeypatch, pages, split):
    """The batches that a task of chunk_pages() or split_pages() gives out, over a stand-in for a table."""
    got = []

    class Rows:
        columns, dtypes = ["page", "page_content"], [("page_content", "string"), ("page", "int")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            got.extend(run(iter([pa.RecordBatch.from_pydict({"_split_text": pages, "page": list(range(len(pages)))})])))

    monkeypatch.setattr(chunking.F, "col", lambda name: type("C", (), {"cast": lambda self, _: self, "alias": lambda self, _: self})())
    split(Rows(), 100, 0)
    return got


@pytest.mark.parametrize("split", [chunk_pages, split_pages])
def test_a_task_never_holds_a_whole_batch(monkeypatch, split):
    """However many pages a batch has, what is given out at once is bounded; all of it is given out, in order."""
    monkeypatch.setattr(chunking, "GIVEN_CHARS", 1_000)
    monkeypatch.setattr(chunking, "GIVEN_ROWS", 8)
    pages = ["word " * (7 * i % 90) for i in range(60)] + [None, "", "end"]
    got = batches_of(monkeypatch, pages, split)
    assert len(got) > 10 and max(len(b) for b in got) <= 8
    rows = [r for b in got for r in b.to_pylist()]
    if split is chunk_pages:
        assert [(r["page"], r["pos"], r["chunk"]) for r in rows] == [(i, k, c) for i, p in enumerate(pages) for k, c in enumerate(split_text(p, 100, 0))]
    else:
        assert [(r["page"], r["chunks"], r["n_chunks"]) for r in rows] == [(i, x := list(split_text(p, 100, 0)), len(x)) for i, p in enumerate(pages)]


def test_stats_do_not_copy_a_page_to_its_chunks(spark, tmp_path, monkeypatch):
    """A page goes through once, not once for each chunk, which is quadratic in its length; counts are those of the chunks."""
    texts = ["word " * 20_000, None, " ", "short", "x" * 3_000]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalogue, "chunk_pages", lambda *_: pytest.fail("a row per chunk"))
    chunks = [c for t in texts for c in split_text(t)]
    assert tuple(catalogue.chunk_stats(spark, str(tmp_path)).first()) == (len(chunks), max(map(len, chunks)), sum(map(len, chunks)), 0, 0, 0)
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert tuple(catalogue.chunk_stats(spark, str(tmp_path / "none")).first()) == (0, None, None, 0, 0, 0)

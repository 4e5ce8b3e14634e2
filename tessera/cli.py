"""python -m tessera.cli ingest [--reset] [--clean] | ask [words ...]; --offline takes the stand-ins for the models."""

from __future__ import annotations

import argparse
import contextlib
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from .functions.text import EXIT_WORDS
from .operators.answering import until_exit
from .operators.models import FirstLineGenerator, HashingEmbedder, HttpEmbedder, HttpGenerator, ModelError, preflight
from .operators.reports import ingest_total
from .operators.store import ChunkStore
from .plans.answer import answer
from .plans.ingest import ingest
from .settings import Settings
from .sources.pdf import NoSource, pdf_files, pdf_pages, require_files


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").getOrCreate()


def run_ingest(settings: Settings, reset: bool, clean: bool, offline: bool, say: Callable[[str], None] = print) -> None:
    if not offline:
        preflight(settings, chat=False)
    spark = session()
    files = require_files(pdf_files(spark, settings.pdf_dir), settings.pdf_dir)  # before anything is reset
    embedder = HashingEmbedder(settings.embed_dim) if offline else HttpEmbedder(settings)
    told = lambda step, counts: say(f"{step}: " + ", ".join(f"{n} {what}" for what, n in counts.items()))
    report = ingest(spark, pdf_pages(files), settings, embedder, reset, clean, told)
    for file, pages, chunks in report.orderBy("source_file").toLocalIterator():
        say(f"{chunks:>8} chunks of {pages:>6} pages  {file}")
    files, pages, chunks = ingest_total(report).first()
    say(f"{chunks:>8} chunks of {pages:>6} pages  in {files} files, now in {settings.collection!r}")


def typed(read: Callable[[str], str]) -> Iterator[str]:
    """Lines until the input ends or is broken off."""
    with contextlib.suppress(EOFError, KeyboardInterrupt):
        while True:
            yield read("? ")


def run_ask(settings: Settings, words: list[str], offline: bool, say: Callable[[str], None] = print, read: Callable[[str], str] = input) -> None:
    """Answers the words, or without any the lines that are read, until exit, quit or the end of input; no line knows of the others.

    All are answered from the version of the store that was the last one at the beginning.
    """
    if not offline:
        preflight(settings)
    spark, one = session(), " ".join(words).strip()
    store = ChunkStore(spark, settings.store_path, settings.collection)
    embedder = HashingEmbedder(settings.embed_dim) if offline else HttpEmbedder(settings)
    generator = FirstLineGenerator(settings.prompt_template) if offline else HttpGenerator(settings)
    if not one:
        say(f"{settings.top_k} chunks of {settings.collection!r} go with each question; {' or '.join(EXIT_WORDS)} ends.")
    with store.pinned() as version:
        rows = store.read(version or None)
        for asked in [one] if one else until_exit(typed(read)):
            question = spark.createDataFrame([(0, asked)], "qid long, question string")
            say(answer(rows, question, settings.top_k, embedder, generator, settings.prompt_template).first()["answer"])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--offline", action="store_true", help="hashing embedder and extractive generator, no model server")
    actions = parser.add_subparsers(dest="action", required=True)
    one = actions.add_parser("ingest", help="bring the PDF files of PDF_DIR into the store")
    one.add_argument("--reset", action="store_true", help="start the collection anew")
    one.add_argument("--clean", action="store_true", help="drop chunks that edited files have left behind")
    actions.add_parser("ask", help="answer a question, or questions line by line").add_argument("words", nargs="*")
    got = parser.parse_args(args)
    settings = Settings.load()
    try:
        if got.action == "ingest":
            run_ingest(settings, got.reset, got.clean, got.offline)
        else:
            run_ask(settings, got.words, got.offline)
    except (ModelError, NoSource) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

import copy
import random
import time

import numpy as np
import pytest

from tessera.llm import sentencepieces


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(sentencepieces.MODEL)
    return sentencepieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_stretches_have_the_word_s_ids(bpe):
    pieces, library = bpe
    rng = random.Random(4)
    for _ in range(300):
        word = sentencepieces.GAP + "".join(rng.choice("abeinrstthqxz.,&$é日本語ñ\n") for _ in range(rng.randint(1, 80)))
        parts = pieces.stretches(word)
        assert "".join(parts) == word
        assert [i for p in parts for i in pieces.fold(p)] == pieces.fold(word) == library.encode(word[1:])


def test_long_words(spark, bpe):
    """Words of 100,000 characters with and without places to cut, and a text without spaces, in bounded time."""
    pieces, library = bpe
    rng = random.Random(6)
    base = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100_000))
    texts = [base, cjk, "the" * 30_000, "e" * 20_000, "short words " + base[:63] + " " + base[:62] + " " + base[:61]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in sentencepieces.encode_documents(docs, pieces, check=True).collect()}
    assert time.perf_counter() - began < 120
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t) and got[i]["round_trip"]


def test_ids_do_not_hang_on_what_is_sent_to_every_task(spark, bpe, monkeypatch):
    pieces, _ = bpe
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeth") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:10] * 3)], "doc_id long, text string").repartition(3)
    rows = [sorted((r["doc_id"], r["ids"]) for r in sentencepieces.encode_documents(docs, pieces, most=most).collect()) for most in (0, 60, 10**6)]
    monkeypatch.setattr(sentencepieces, "SAMPLE", 5)
    rows.append(sorted((r["doc_id"], r["ids"]) for r in sentencepieces.encode_documents(docs, pieces).collect()))
    assert rows[0] == rows[1] == rows[2] == rows[3]


def test_only_what_is_too_long_is_folded_in_the_task(bpe):
    """Without the ids that the lattice gives, a text of words of up to LONGEST characters can't be encoded: nothing else stands in for it."""
    pieces, library = bpe
    text = "the words of this text, nndenächtz & " + "e" * 61
    only = copy.copy(pieces)
    only.fold = lambda word: 1 / 0
    encoder = sentencepieces.Encoder(only, {})
    own = {p: np.asarray(pieces.fold(p), "<i4").tobytes() for p in encoder.unseen(text)}
    assert encoder.encode(text, dict(own)).tolist() == library.encode(text)
    for p in own:
        with pytest.raises(KeyError):
            encoder.encode(text, {q: x for q, x in own.items() if q != p})
    with pytest.raises(ZeroDivisionError):
        encoder.encode("e" * 100, {})


def test_frequent_words_do_not_hang_on_how_rows_are_dealt(spark):
    """A word that each task meets once is as frequent as one that a single task meets as often; one that the whole sample has once is left out."""
    docs = spark.createDataFrame([(i, f"often only{i}") for i in range(8)], "doc_id long, text string")
    found = [{r["word"] for r in sentencepieces.frequent_words(docs.repartition(n)).collect()} for n in (1, 8)]
    assert found[0] == found[1] == {sentencepieces.GAP + "often"}

import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing

from .test_operators import fewest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    """The library's tokenizer as it comes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


SPECIAL = "<|endoftext|>"


@pytest.mark.parametrize("text", [f"a {SPECIAL} b", SPECIAL, f"{SPECIAL}{SPECIAL}", f"  {SPECIAL}  x\n{SPECIAL}", f"{SPECIAL[:-1]} {SPECIAL}>", f"it's{SPECIAL}'s", f"\n {SPECIAL} \n", ""])
def test_strings_of_special_tokens(library, text):
    own = packing.Ids(packing.tokenizer_path())
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert np.frombuffer(b"".join(map(own.part, packing.cut(text, 3))), "<u4").tolist() == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([SPECIAL, " ", "\n", "a", "é", "<|", "12", "'s", "\u3000"]), max_size=12).map("".join))
def test_strings_of_special_tokens_among_others(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    library, own = _cached("library", lambda: Tokenizer.from_file(path)), _cached("own", lambda: packing.Ids(path))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


_held = {}


def _cached(name, make):
    return _held[name] if name in _held else _held.setdefault(name, make())


def test_all_documents_have_the_library_s_ids(spark, library):
    own = packing.Ids(packing.tokenizer_path())
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").toLocalIterator():
        assert np.frombuffer(own.encode(r["text"] or ""), "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids


def test_long_and_null_texts(spark):
    rows = [(1, "word " * 30_000), (2, None), (3, "x" * 50_000), (3, "x" * 50_000), (None, "a")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {i: len(p) for i, p in pieces.items() if i in (2, None)} == {2: 1, None: 1} and pieces[2][0]["length"] == 1
    assert all(r["length"] == 2048 for r in got if r["piece"] > 0) and len(pieces[3]) % 2 == 0


def total(plan):
    return sum(f.times for f in plan)


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(fit)] -= x
    return len(rooms)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_is_item_by_item(lengths):
    counts = np.bincount(lengths, minlength=21)
    plan = packing.best_fit(counts, 20)
    used = np.zeros(21, int)
    for f in plan:
        assert sum(n * x for x, n in f.parts) <= 20
        for x, n in f.parts:
            used[x] += n * f.times
    assert (used == counts).all() and total(plan) == plain_best_fit(lengths, 20)
    assert total(packing.best_plan(counts, 20)) <= total(plan)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_plans_are_the_shortest(lengths):
    counts = np.bincount(lengths, minlength=21)
    assert packing.least_sequences(counts, 20) <= total(packing.best_plan(counts, 20)) == fewest(lengths, 20)


def test_where_largest_first_fails():
    assert total(packing.best_plan(np.bincount([3, 5, 7, 8, 8, 8, 9, 10], minlength=21), 20)) == 3


@pytest.mark.parametrize("slack", [0, 3, 20])
def test_fillings_are_the_undominated_ones(slack):
    """Against all fillings of small cases: each left out has one in place of it, made by a swap that the rule names; none comes twice."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 13, rng.integers(1, 8)).tolist()
        counts, largest = np.bincount(lengths, minlength=21), max(lengths)
        rest = sorted(lengths)
        rest.remove(largest)
        every = {c for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if sum(c) <= 20 - largest}
        got = [tuple(sorted(x for x, n in parts[1:] for _ in range(n))) for parts in packing.fillings(counts, largest, 20, slack)]
        assert len(got) == len(set(got)) and set(got) <= every
        if slack == 0:
            assert [sum(g) for g in got] == sorted(map(sum, got), reverse=True)

        def swaps(c):
            waste = 20 - largest - sum(c)
            spare = list(rest)
            for x in c:
                spare.remove(x)
            return [(out, x) for n in range(len(c) + 1) for out in itertools.combinations(c, n) for x in spare if sum(out) <= x <= sum(out) + waste and not (n == 1 and out[0] == x)]

        assert set(got) == {c for c in every if not swaps(c)}


def test_plans_of_hard_lengths():
    counts = np.bincount(np.random.default_rng(1).integers(300, 1101, 20_000), minlength=2049)
    began = time.perf_counter()
    plan = packing.best_plan(counts, 2048)
    assert time.perf_counter() - began < 30 and total(plan) < total(packing.best_fit(counts, 2048))


def test_a_table_of_one_length_and_an_empty_one(spark):
    rows = spark.range(1000).select(F.lit(700).cast("long").alias("length"))
    assert packing.pack(rows).agg(F.countDistinct("sequence_id")).first()[0] == 500
    assert packing.pack(rows.limit(0)).count() == 0

"""What all operators share: empty tables, nulls, clashing columns, repeated rows."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, langid, nearcopies, packing, quality, sentencepieces, sharding, simhash, topk, toxicity, urlfilter

from .conftest import rows_of


@pytest.fixture(scope="module")
def operators(corpus):
    docs, labels = corpus
    import public_tokenizers

    profiles = langid.learn_profiles(docs)
    good = quality.fit(quality.labelled_sample(docs, labels, "quality"))
    toxic = toxicity.fit(quality.labelled_sample(docs, labels, "toxic"))
    pieces = sentencepieces.Pieces.load(public_tokenizers.path(sentencepieces.MODEL))
    return {
        "langid": lambda d: langid.identify_languages(d, profiles),
        "quality": lambda d: quality.score_quality(d, good),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxic),
        "sentences": lambda d: toxicity.offending_sentences(d, toxic),
        "simhash": simhash.near_duplicates,
        "sentencepieces": lambda d: sentencepieces.encode_documents(d, pieces),
        "sharding": lambda d: sharding.shard_documents(d).drop("slot"),
        "fingerprints": fingerprints.fingerprint_documents,
        "edits": fingerprints.fingerprint_edits,
        "packing": lambda d: packing.pack_documents(d).drop("sequence_id", "offset"),
    }


NAMES = ["langid", "quality", "toxicity", "sentences", "simhash", "sentencepieces", "sharding", "fingerprints", "edits", "packing"]
PER_ROW = [n for n in NAMES if n not in ("sentences", "packing")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, corpus, name):
    assert operators[name](corpus[0].limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(operators, corpus, clashing, name):
    assert rows_of(operators[name](clashing(corpus[0]))) == rows_of(operators[name](corpus[0]))


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row_and_repeats_alike(operators, corpus, name):
    docs = corpus[0]
    assert operators[name](docs).count() == docs.count()
    twice = operators[name](docs.filter("doc_id IN (1, 2, 302, 303)").unionByName(docs.filter("doc_id IN (1, 303)")))
    got = rows_of(twice)
    assert len(got) == 6 and len(set(got)) == 4


@pytest.mark.parametrize("name", PER_ROW)
def test_all_null(operators, spark, name):
    null = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert operators[name](null).count() == 2


def test_stages_keep_columns(corpus, clashing, spark):
    docs, labels = corpus
    more = clashing(docs)
    for stage in (langid.keep_identified, lambda d: quality.keep_good(d, labels), simhash.keep_one_each):
        assert stage(more).dtypes == more.dtypes and stage(docs.limit(0)).count() == 0
        assert {r[0] for r in stage(more).select("doc_id").collect()} == {r[0] for r in stage(docs).select("doc_id").collect()}


def test_one_row_of_each_group(spark, corpus):
    """One id with two texts, copies without an id, repeated rows."""
    docs, texts = corpus[0], [r["text"] for r in corpus[0].filter("doc_id IN (1, 2, 4)").orderBy("doc_id").collect()]
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[1]), (None, None), (9, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    for named in (simhash.near_duplicates, nearcopies.near_copies):
        kept = simhash.keep_one_each(table, named=named).collect()
        assert sorted(((r["doc_id"] or -1), r["text"]) for r in kept) == sorted([(3, texts[0]), (5, texts[1]), (-1, texts[2]), (9, "")])


def test_learning_from_nothing(corpus, spark):
    docs, labels = corpus
    none = labels.limit(0)
    assert {r["score"] for r in quality.score_quality(docs, quality.fit(quality.labelled_sample(docs, none, "quality"))).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(quality.labelled_sample(docs, none, "toxic"))).collect()) < 0.5
    profiles = langid.learn_profiles(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify_languages(docs, profiles).collect()} == {("und", 0.0)}
    assert quality.keep_good(docs, none).count() == docs.count() == langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count()


def test_search_and_urls_edges(spark, clashing):
    v = spark.createDataFrame([(1, [1.0, 0.5]), (2, [float("nan"), 1.0]), (3, None), (None, [1.0]), (4, [None, 1.0]), (5, []), (6, [float("inf")]), (7, [1e300, 1.0]), (1, [1.0, 0.5]), (8, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(clashing(v), v, 3).collect()}
    assert {k[0] for k in got} == {1, 5, 7, 8} and got[1, 2] == (8, 64 * 64 + 32 * 32) and got[1, 1] == (7, topk.LONG - 1) and got[5, 1] == (1, 0) and got[5, 3] == (8, 0)
    assert topk.search(v.limit(0), v).count() == topk.search(v, v.limit(0)).count() == 0
    captures = spark.createDataFrame([(1, "http://A.b.com/x", "2024-01-05"), (2, None, "2024-01-05"), (3, "x", "2024-01-05"), (4, "http://b.com", None), (None, "//b.com:8080", "2023-01-01")], "page_id long, url string, fetched_at string")
    entries = spark.createDataFrame([("b.com", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("b.com", None, "block")], "domain string, listed_at string, action string")
    found = {r["page_id"]: (r["host"], r["matched_domain"], r["allowed"]) for r in urlfilter.filter_urls(clashing(captures), entries).collect()}
    assert found == {1: ("a.b.com", "b.com", False), 2: (None, None, True), 3: (None, None, True), 4: ("b.com", None, True), None: ("b.com", None, True)}
    assert all(r["allowed"] for r in urlfilter.filter_urls(captures, entries.limit(0)).collect()) and urlfilter.filter_urls(captures.limit(0), entries).count() == 0

import itertools

import corpus_pipeline
from tessera.llm import langid, quality

from .conftest import DOCS
from .test_nearcopies import plain_shingles, similarity
from .test_operators import groups


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    docs = docs.filter("doc_id IS NOT NULL")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_dedup", "best_fit_packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == docs.dtypes
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (now, out))
        assert all(before[i] == r for i, r in after.items())
        if name == "language_id":
            found = {r["doc_id"]: r for r in langid.identify_languages(now, langid.learn_profiles(now.filter(~langid.common.held_out()))).collect()}
            assert set(after) == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE}
        elif name == "quality_classifier":
            good = {r["doc_id"]: r["quality"] for r in labels.dropna().collect()}
            assert all(bool(good.get(i, 1)) for i in after) and all(i in after for i in before if good.get(i) == 1)
        else:
            sets = {i: plain_shingles(r["text"]) for i, r in before.items()}
            near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= 0.8]
            assert set(after) == set(groups(sets, near).values())
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}
    assert quality.LEAST_SCORE == 0.3


def test_edges(spark, corpus, clashing, tmp_path):
    """The whole pipeline over an empty table, over null ids and texts only, and with columns of the names that stages use."""
    docs, labels = corpus

    def run(name, table):
        (tmp_path / name).mkdir()
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        return sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect())

    assert run("empty", docs.limit(0)) == []
    null = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert run("null", null) == [(-1, 0, 1)]  # one of three empty documents: its end mark
    assert run("clashing", clashing(docs)) == run("plain", docs) != []

"""Whole results of ops 1, 4, 6 and 8 against plain recomputations."""

import math
import re
import struct
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import langid, quality, sharding, toxicity

from .test_operators import held, plain_grams


def test_every_shard_is_that_of_the_greatest_score(spark, corpus):
    docs, weights = corpus[0], (1.0, 2.5, 0.0, 1.0, 0.25)

    def plain(key, weights):
        rated = []
        for shard, weight in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(key.encode(), 42))
            if weight:
                rated.append((-weight / math.log(((h >> 11) + 0.5) / 2**53), -shard))
        return -max(rated)[1]

    got = sharding.shard_documents(docs, weights, (*weights, 3.0)).collect()
    assert len(got) == docs.count() and len({r["shard"] for r in got}) == 4
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain(key, weights), plain(key, (*weights, 3.0)))


def test_every_language_by_out_of_place_distance(corpus):
    docs = corpus[0]
    rows, ranks = docs.collect(), 60
    order = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][:ranks]
    number = lambda g: sum((1 if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    profiles = {}
    for lang in ("de", "en"):
        own = [plain_grams(r["text"]) for r in rows if r["lang"] == lang and r["text"] is not None and not held(r["doc_id"])]
        profiles[lang] = order(sum(own, Counter()))
    learned = langid.learn_profiles(docs.filter(~langid.common.held_out()), ranks=ranks)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(docs, learned).collect()}
    for r in rows:
        own = order(plain_grams(r["text"] or ""))
        if not own:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        away = {lang: sum(abs(p.index(g) - k) if g in p else ranks for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        assert got[r["doc_id"]][0] == best and math.isclose(got[r["doc_id"]][1], 1 - away[best] / (ranks * len(own)))


def test_every_toxicity_is_noisy_or_of_its_sentences(corpus):
    docs, labels = corpus
    model = toxicity.fit(quality.labelled_sample(docs, labels, "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for r in docs.collect():
        clean, worst = 1.0, 0.0
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", r["text"] or ""):
            words = set(re.findall(r"\w+", sentence.lower()))
            if not words:
                continue
            have = {w for w in words} | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}
            p = 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in have))))
            clean, worst = clean * (1 - p), max(worst, p)
        assert math.isclose(got[r["doc_id"]]["score"], 1 - clean, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(got[r["doc_id"]]["sentence_score"] or 0.0, worst, rel_tol=1e-9, abs_tol=1e-12)


def test_quality_is_the_ridge_solution_with_isotonic_steps(corpus):
    docs, labels = corpus
    sample = quality.labelled_sample(docs, labels, "quality")
    model = quality.fit(sample, features=32)
    rows = sample.selectExpr("text", "label", "pmod(xxhash64(id, 'steps'), 4) = 0 AS own").collect()
    x, y, own = np.array([quality.statistics(r["text"]) for r in rows]), np.array([r["label"] for r in rows]), np.array([r["own"] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0)))
    z = model.features(x)
    # least squares over the rows with a penalty on all weights but the constant's, by a solver of its own
    n = int((~own).sum())
    penalty = np.sqrt(quality.PENALTY * n) * np.eye(z.shape[1])
    penalty[-1, -1] = math.sqrt(1e-9)
    weights = np.linalg.lstsq(np.vstack([z[~own], penalty]), np.concatenate([y[~own], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ weights, model.raw(x), atol=1e-6)
    # the isotonic fit by its min-max formula, at the rows that set the steps
    raw, target = model.raw(x[own]), y[own]
    order = np.argsort(raw, kind="stable")
    raw, target = raw[order], target[order]
    total = np.concatenate([[0.0], np.cumsum(target)])
    mean = lambda a, b: (total[b + 1] - total[a]) / (b + 1 - a)
    size = len(raw)
    steps = [max(min(mean(a, b) for b in range(i, size)) for a in range(i + 1)) for i in range(size)]
    at, values = model.steps
    assert np.allclose(sorted(set(np.round(steps, 9))), np.unique(np.round(values, 9)))
    pools = [np.flatnonzero(np.isclose(steps, v)) for v in values]
    assert np.allclose(at, [raw[p].mean() for p in pools])
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for r in docs.collect():
        value = float(np.clip(np.interp(model.raw(quality.statistics(r["text"])[None])[0], at, values), 0, 1))
        assert math.isclose(scores[r["doc_id"]], value, abs_tol=1e-12)

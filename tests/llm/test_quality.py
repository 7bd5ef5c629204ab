"""Naive Bayes support vectors: n-grams, ratios and the fit against plain versions, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from structura.llm import quality, queries

from .conftest import docs_df


def naive_ngrams(text: bytes) -> set:
    """All n-grams as (kind, parts), without hashing of buckets."""
    words = text.split()
    low = [w.lower() for w in words]
    shapes = [(quality.shape(w), k > 0 and low[k] == low[k - 1]) for k, w in enumerate(words)]
    out = set()
    for kind, seq, n in ((1, low, 1), (2, low, 2), (3, shapes, 1), (4, shapes, 2), (5, shapes, 3)):
        out |= {(kind, *seq[k:k + n]) for k in range(len(seq) - n + 1)}
    return out


def test_ngrams_are_one_bucket_for_each_distinct_ngram(words, monkeypatch):
    rng = random.Random(4)
    texts = [b"", b" \n", b"One", b"a a a a b", "Ärger über!! 12x x12".encode(), *(words(rng.randint(1, 60)).encode() for _ in range(40)),
             b"THE!! the!! dog*** | dog" * 9, b"x" * 700 + b" end " + b"y" * 900]
    whole = [quality.ngrams(quality.Words(), t) for t in texts]
    bucket: dict = {}
    for t, got in zip(texts, whole, strict=True):
        want = naive_ngrams(t)
        assert (np.diff(got) > 0).all() and abs(len(got) - len(want)) <= 2  # two n-grams may share a bucket
        for g in want:
            key = quality.ngrams(quality.Words(), b" ".join(g[1:])) if g[0] in (1, 2) else None
            if key is not None:
                assert set(key.tolist()) & set(got.tolist())
                assert bucket.setdefault(g, key.tolist()) == key.tolist()
    monkeypatch.setattr(quality, "STEP_BYTES", 16)
    monkeypatch.setattr(quality, "CACHE_WORDS", 5)
    used = quality.Words()
    for t, want in zip(texts, whole, strict=True):
        assert quality.ngrams(used, t).tolist() == want.tolist()


def test_shape():
    assert [quality.shape(w) for w in (b"Dog", b"DOG!!", "über***".encode(), b"a1.b", b"|", b"aA" * 20)] == [b"Aa", b"A!", b"a*", b"a0.a", b"|", b"aAaAaAaA"]


def test_ratios_and_descent_equal_plain_versions(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(quality, "BUCKETS", 12)
    monkeypatch.setattr(quality, "LEAST_ROWS", 2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(40)]
    y = np.array([int(3 in r or (5 in r and 7 not in r)) for r in rows])
    y[:3] = 1 - y[:3]
    ratios = quality.log_count_ratios(rows, y)
    for j in range(12):
        p, q = (sum(j in r for r, c in zip(rows, y, strict=True) if c == k) for k in (1, 0))
        want = math.log((p + 1) / (y.sum() + 2)) - math.log((q + 1) / ((1 - y).sum() + 2)) if p + q >= 2 else 0
        assert ratios[j] == pytest.approx(want)
    costs = rng.uniform(0.1, 1, 40)
    w, offset, alpha = quality.hinge_descent(rows, ratios, y, costs, epochs=4_000, tolerance=1e-10)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    x[:, 12] = 1
    sign = np.where(y > 0, 1.0, -1.0)
    assert np.allclose(np.append(w, offset), (alpha * sign) @ x) and (alpha >= 0).all() and (alpha <= costs).all()

    def primal(v):
        return v @ v / 2 + (costs * np.maximum(0, 1 - sign * (x @ v))).sum()
    dual = alpha.sum() - ((alpha * sign) @ x) @ ((alpha * sign) @ x) / 2
    assert primal(np.append(w, offset)) == pytest.approx(dual, rel=1e-6)  # no gap: the optimum
    for _ in range(200):
        assert primal(np.append(w, offset) + rng.normal(0, 0.05, 13)) >= dual - 1e-6


def test_threshold_lies_at_the_best_cut():
    margins, y = np.array([-3.0, -1, 0.5, 1, 2, 5]), np.array([0, 0, 0, 1, 1, 1])
    assert quality._best_cut(margins, y) == 0.75
    slope = quality._slope(margins - 0.75, y)
    model = quality.Model(np.zeros(quality.BUCKETS), 0.0, 0.75, slope)
    assert ((model.score(margins) >= quality.THRESHOLD).astype(int) == y).all() and slope > 0


def made(words, rng, n):
    rows, labels = [], []
    for i in range(n):
        text, good = words(rng.randint(5, 60)), int(rng.random() < 0.7)
        if not good:
            text = " ".join(w + "***" for w in text.split()) if rng.random() < 0.5 else " ".join([text.split()[0]] * 30)
        rows.append((i, text))
        labels.append((i, good, 0))
    return rows, labels


def test_held_out_quality(spark, words):
    rows, labels = made(words, random.Random(9), 500)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_df(spark, rows)
    got = quality.score_documents(docs, quality.train(docs, labels_df)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert len(got) == 500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 60
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    # held-out labels have no say
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = quality.score_documents(docs, quality.train(docs, flipped)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in got)


def test_odd_rows_and_few_labels(spark, words):
    rows, labels = made(words, random.Random(1), 120)
    odd = [(None, None), (900, None), (901, ""), (902, " \n"), (3, "again"), (3, "again"), (903, "word " * 300_000), (904, "x" * 3_000_000)]
    docs = docs_df(spark, rows + odd).selectExpr("*", "1 as score", "'h' as held_out", "2 as id", "3 as label", "4 as h")
    labels_df = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (6, 0, 0), (7_000, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, quality.train(docs, labels_df)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (None, 900, 901, 902)}
    assert len(empty) == 1 and len({r.score for r in got if r.doc_id == 3}) <= 2
    for none in ([], [(1, 1, 0), (2, 1, 0)]):
        model = quality.train(docs, spark.createDataFrame(none, "doc_id long, quality int, toxic int"))
        assert {(round(r.score, 9), r.predicted) for r in quality.score_documents(docs, model).collect()} == {(0.3, 1)}
    assert quality.score_documents(docs_df(spark, []), model).count() == 0


def test_query_has_one_row_for_each_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op12_quality"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())

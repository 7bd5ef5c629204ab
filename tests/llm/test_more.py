"""Shards against an independent descent, convolution against a plain one, and columns with clashing names."""

import math
import random

import numpy as np
import pytest
import xxhash

from structura.llm import lattice_lm, nn_descent, packing, segment, token_counts, toxicity, warc
from structura.llm.sharding import Level, assign_shards

from .conftest import docs_df


def _descend(key, nodes, path=""):
    """The path of positions to the leaf with the smallest draw at every level."""
    best = None
    for i, node in enumerate(nodes):
        name = f"{path}/{node.kind}{i}"
        h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
        weight = node.below if isinstance(node.below, float) else sum(_leaves(node))
        if weight > 0:
            draw = -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight
            if best is None or draw < best[0]:
                best = draw, i, node, name
    _, i, node, name = best
    return (i,) if isinstance(node.below, float) else (i, *_descend(key, node.below, name))


def _leaves(node):
    return [node.below] if isinstance(node.below, float) else [w for x in node.below for w in _leaves(x)]


def _number(nodes, place):
    first = sum(len(_leaves(x)) for x in nodes[:place[0]])
    return first if len(place) == 1 else first + _number(nodes[place[0]].below, place[1:])


def test_shards_equal_an_independent_descent(spark, words):
    four = [Level("rack", [Level("shard", 1.0), Level("shard", 2.5)]), Level("rack", [Level("shard", 0.5), Level("shard", 0.0), Level("shard", 1.0)])]
    tree = [Level("region", four), Level("region", [Level("rack", [Level("shard", 3.0)])])]
    grown = [*tree, Level("region", [Level("rack", [Level("shard", 1.5)])])]
    rows = [(i, words(1)) for i in range(600)] + [(None, "x"), (7, "again")]
    got = assign_shards(docs_df(spark, rows).selectExpr("*", "1 as shard", "2 as size", "'x' as law", "3 as at", "4 as part"), tree, grown).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (_number(tree, _descend(key, tree)), _number(grown, _descend(key, grown)))


def _model(rng):
    f = sum(toxicity.FILTERS.values())
    return toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.WIDTH)).astype(np.float32),
                          {w: rng.normal(0, 0.3, (w, toxicity.WIDTH, n)).astype(np.float32) for w, n in toxicity.FILTERS.items()},
                          {w: rng.normal(0, 0.1, n).astype(np.float32) for w, n in toxicity.FILTERS.items()}, rng.normal(0, 0.5, 2 * f).astype(np.float32), 0.2)


def test_convolution_equals_a_plain_one(words):
    rng = np.random.default_rng(4)
    model = _model(rng)
    texts = [b"", b"one", *(words(n).encode() for n in (2, 61, 62, 63, 64, 65, 200))]
    seen = toxicity.Words()
    docs = [seen.numbers(t) for t in texts]
    got = toxicity._raw(model, seen, docs)
    for text, score in zip(texts, got, strict=True):
        vectors = [sum(model.embeddings[b] for b in toxicity.buckets(w)) for w in text.lower().split()]
        padded = vectors + [np.zeros(toxicity.WIDTH, np.float32)] * (toxicity.SEGMENT + 4)
        segments = -(-(len(vectors) + 2) // toxicity.SEGMENT)
        maxima = []
        for s in range(segments):
            best = []
            for width, w in model.filters.items():
                outs = [sum(padded[at + k] @ w[k] for k in range(width)) + model.biases[width]
                        for at in range(s * toxicity.SEGMENT, min((s + 1) * toxicity.SEGMENT, len(vectors)))]
                best.append(np.max(outs, axis=0) if outs else np.full(w.shape[2], -1.0))
            maxima.append(np.maximum(np.concatenate(best), 0))
        feats = np.concatenate((np.mean(maxima, axis=0), np.max(maxima, axis=0)))
        assert score == pytest.approx(1 / (1 + math.exp(-(feats @ model.top + model.offset))), rel=1e-4)


CLASH = ["1 as tokens", "'c' as cluster", "2 as score", "true as held_out", "3 as id", "4 as chunk", "'w' as word", "5 as n_tokens", "6 as h", "7 as label"]


def _same(plain, clashing, columns=None):
    key = lambda df: sorted(repr(tuple(r)) for r in (df.select(*columns) if columns else df).collect())
    assert key(plain) == key(clashing)


def test_clashing_columns_change_nothing(spark, words):
    rng = random.Random(2)
    rows = [(i, words(rng.randint(0, 30))) for i in range(30)] + [(None, None), (31, "")]
    docs = docs_df(spark, rows)
    more = docs.selectExpr("*", *CLASH)
    _same(token_counts.count_tokens(docs), token_counts.count_tokens(more))
    _same(segment.segment_documents(docs, n=2), segment.segment_documents(more, n=2))
    _same(lattice_lm.score_documents(docs), lattice_lm.score_documents(more))
    _same(packing.pack_documents(docs, capacity=40), packing.pack_documents(more, capacity=40))
    model = _model(np.random.default_rng(1))
    _same(toxicity.score_documents(docs, model), toxicity.score_documents(more, model))
    left = toxicity.reject(more, model)
    assert left.columns == more.columns
    _same(toxicity.reject(docs, model), left, docs.columns)


def test_clashing_columns_of_pages_and_vectors(spark, words):
    pages = spark.createDataFrame([(i, f"http://e.com/{i}", words(40 if i % 3 else 1)) for i in range(12)] + [(20, None, None)], "page_id long, url string, html string")
    _same(warc.round_trip(pages), warc.round_trip(pages.selectExpr("*", "'d' as digest", "1 as payload", "2 as first_id", "3 as turn", "4 as copies")))
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    _same(nn_descent.search(vectors, k=3, every=20), nn_descent.search(vectors.selectExpr("*", "1 as node", "2 as data", "3 as size", "4 as h", "5 as n", "6 as score"), k=3, every=20))

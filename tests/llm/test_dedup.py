"""Exact and SimHash dedup against brute force, with planted copies and odd rows."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from structura.llm import exact_dedup, fuse, simhash
from structura.llm.components import star_components
from structura.llm.common import Scratch

from .conftest import docs_df


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _exact_truth(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    out, first = [], set()
    for i, t in rows:
        ids = [x for x in groups[_norm(t)] if x is not None]
        keep = min(ids, default=None)
        kept = i == keep and (_norm(t)) not in first
        if kept:
            first.add(_norm(t))
        out.append((i, keep, len(groups[_norm(t)]), kept, hashlib.sha256(_norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(words):
    base = [(i, words(1 + i % 40)) for i in range(0, 120, 2)]
    copies = [(i + 1, base[i % 7][1].replace(" ", "\t\n", 1)) for i in range(0, 60, 2)]
    odd = [(500, None), (501, ""), (502, "  "), (503, "\n"), (None, base[0][1]), (None, "only here"), (2, base[1][1]), (2, base[1][1]),
           (2, "another text"), (505, " lead"), (506, "lead"), (507, "non breaking"), (508, "non breaking"), (509, "x" * 200_000), (510, "x" * 200_000)]
    return base + copies + odd


@pytest.mark.parametrize("digest_bytes,snapshots", [(32, 3), (1, 2), (32, 1)])
def test_exact_groups_equal_brute_force(spark, rows, digest_bytes, snapshots):
    """With one-byte digests different texts collide, and the byte check has to tell them apart."""
    got = exact_dedup.duplicate_groups(docs_df(spark, rows), snapshots, digest_bytes=digest_bytes).collect()
    mine = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str)
    assert mine == _exact_truth(rows)


def test_drop_duplicates_keeps_one_row_each(spark, rows):
    left = exact_dedup.drop_duplicates(docs_df(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted([(i, s) for i, _, _, kept, s in _exact_truth(rows) if kept], key=str)
    assert sorted([(r.doc_id, hashlib.sha256(_norm(r.text).encode()).hexdigest()) for r in left.collect()], key=str) == want


def test_empty_tables_and_clashing_columns(spark):
    none = docs_df(spark, [])
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, "a b", "d", 5, True), (2, "a  b", "d", 6, False)], "doc_id long, text string, digest string, keep_id int, kept boolean")
    assert [r.doc_id for r in exact_dedup.drop_duplicates(df).collect()] == [1]
    clash = df.withColumnRenamed("digest", "print").withColumnRenamed("keep_id", "component_id")
    assert simhash.near_duplicates(clash).count() == 2
    assert [r.doc_id for r in simhash.keep_first(clash).collect()] == [1]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter_has_no_false_negatives_and_few_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = fuse.build(keys)
    assert f.contains(keys).all()
    if n > 100:
        others = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
        assert f.contains(others).mean() < 0.01
        assert len(f.cells) < 1.5 * n + 2000


def _print_truth(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in prints}


def test_simhash_equals_brute_force(spark, words):
    rng = random.Random(3)
    rows = [(i, words(rng.choice([0, 1, 2, 3, 4, 60, 300]))) for i in range(80)]
    for i in range(80, 200):
        text = rows[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(3)):
            if text:
                text[rng.randrange(len(text))] = words(1)
        rows.append((i, "  ".join(text)))
    rows += [(300, None), (301, ""), (302, "É éa É"), (303, "The THE the"), (304, "the the the")]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs_df(spark, rows)).collect()}
    prints = {i: _print_truth(t) for i, t in rows}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == _components(prints, 2)
    kept = {r.doc_id for r in simhash.keep_first(docs_df(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_keep_first_keeps_one_row_of_each_component(spark, words):
    """Null and repeated ids whose texts differ: each component of texts keeps one row, whatever its ids."""
    texts = [words(60) for _ in range(9)]
    near = [t + "  " for t in texts]  # other text, same fingerprint
    rows = [(3, texts[0]), (None, near[0]), (None, texts[1]), (None, texts[2]), (None, near[2]),
            (5, texts[3]), (5, near[0]), (5, texts[4]), (5, near[4]), (7, texts[5]), (7, texts[5]), (8, near[5]),
            (None, texts[6]), (9, near[6]), (5, texts[7]), (4, near[7]), (None, None), (11, ""), (12, texts[8])]
    left = simhash.keep_first(docs_df(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(3, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5]), (9, near[6]), (4, near[7]),
            (11, ""), (12, texts[8])]
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_equal_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)),
                             base ^ np.uint64(7), base ^ np.uint64(3), rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    bucket = np.sort(np.concatenate([np.zeros(150, np.int64), rng.integers(1, 60, len(prints) - 150)]))
    prints = rng.permutation(prints)
    a, b = simhash._pairs(prints, bucket, radius)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in combinations(range(len(prints)), 2)
            if bucket[i] == bucket[j] and bin(int(prints[i] ^ prints[j])).count("1") <= radius}
    assert got == want


def test_links_cut_wide_buckets_without_losing_any(spark, monkeypatch):
    """All fingerprints agree in their upper half, so buckets are wide and are cut again."""
    monkeypatch.setattr(simhash, "WIDE_BUCKET", 8)
    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << 14, 300)
    prints = {k: int(p) for k, p in enumerate(sorted(set((0xABCD << 40) + int(x) for x in low)))}
    df = spark.createDataFrame([(p,) for p in prints.values()], "print long")
    edges = simhash.links(df, 2, Scratch(spark, "test"))
    stars = {r.a: r.b for r in star_components(edges, Scratch(spark, "test")).collect()}
    want = _components(prints, 2)
    groups = lambda label: sorted(map(sorted, {v: [k for k in prints if label(k) == v] for v in map(label, prints)}.values()))
    assert groups(lambda k: stars.get(prints[k], prints[k])) == groups(lambda k: want[k])


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1000)]
    got = {r.a: r.b for r in star_components(spark.createDataFrame(path + star + path[:3], "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}

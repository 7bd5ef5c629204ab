"""Vector codes against a brute-force version."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from structura.llm.vector_codes import Traversal, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry, in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    books, out = {}, []
    for dims in {len(v) for _, v, _ in kept}:
        own = [(i, v + [0] * (-dims % parts), lab) for i, v, lab in kept if len(v) == dims]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = len(own[0][1]) // parts
        cut = lambda v, p, width=width: v[p * width:(p + 1) * width]
        book = [[cut(v, p) for _, v, _ in own[:entries]] for p in range(parts)]
        near = lambda x, p, book=book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p]))
        for _ in range(rounds):
            for p in range(parts):
                members = defaultdict(list)
                for _, v, _ in own:
                    members[near(cut(v, p), p)[1]].append(cut(v, p))
                for e, xs in members.items():
                    book[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
        for i, v, lab in own:
            found = [near(cut(v, p), p) for p in range(parts)]
            out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), sha))
        books[dims] = book
    labels = defaultdict(int)
    for _, lab, _, error, _ in out:
        labels[lab] += error
    return sorted(((i, code, error, labels[lab], sha) for i, lab, code, error, sha in out), key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in vector_codes(df, **options).collect()), key=repr)
    assert got == truth(rows, **options)
    return got


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    # few values a component: many equal parts, shared prefixes and ties
    rows = [(i * 7 % 301, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) for _ in range(16)], rng.choice([None, 1, 2, 3])) for i in range(300)]
    check(spark, rows)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)], i % 4) for i in range(200)]
    check(spark, rows, parts=4, entries=5, rounds=3)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.1, None] * 4, 1), (3, [nan] + [0.1] * 7, 1), (4, [inf] * 8, 1), (5, [-inf] + [0.0] * 7, 1)]
    assert check(spark, rows) == []
    assert check(spark, []) == []
    rows += [(6, [0.5] * 8, None), (6, [0.5] * 8, None), (None, [0.25] * 8, None), (None, [-0.3] * 8, 2), (7, [], 2), (7, [0.1, 0.2, 0.3], 2), (8, [-0.9] * 8, 2), (6, [0.4] * 8, 2)]
    got = check(spark, rows)
    assert len(got) == 8
    extra = spark.createDataFrame([(*r, "x", 5, "k") for r in rows], SCHEMA + ", code string, error int, key string")
    assert sorted((tuple(r) for r in vector_codes(extra).collect()), key=repr) == got
    with pytest.raises(ValueError, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e12] * 8, 1)], SCHEMA))


def test_traversal_shares_prefixes_across_runs(monkeypatch):
    monkeypatch.setattr("structura.llm.vector_codes.RUN", 7)
    rng = np.random.default_rng(1)
    leaves = np.unique(rng.integers(-2, 3, (400, 4)), axis=0)
    entries = rng.integers(-3, 4, (16, 4))
    walk = Traversal(entries)
    best, distance = (np.concatenate(x) for x in zip(*(walk(leaves[at:at + 50]) for at in range(0, len(leaves), 50))))
    every = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    # one node for each distinct prefix, however the leaves are cut into runs
    assert walk.nodes == sum(len(np.unique(leaves[:, :d + 1], axis=0)) for d in range(4))

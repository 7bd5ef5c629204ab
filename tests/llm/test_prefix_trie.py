"""The conversation trie against nested dicts."""

import hashlib
import random
import zlib

from structura.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def item(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text


def truth(rows, stride=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), *item(role, text)))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seq = own.get(c - c % stride, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            node = nodes.setdefault(tuple(seq[:d]), {"members": set(), "ends": set()})
            node["members"].add(c)
            if d == len(seq):
                node["ends"].add(c)
    for p, x in nodes.items():
        x |= {"kids": 0, "leaves": 0, "saved": 0, "own": (len(x["members"]) - 1) * len(p[-1][1]) if p else 0}
    for p in nodes:
        if p:
            nodes[p[:-1]]["kids"] += 1
    for p, x in nodes.items():
        for d in range(len(p) + 1):
            nodes[p[:d]]["leaves"] += x["kids"] == 0
            nodes[p[:d]]["saved"] += x["own"]
    return sorted((min(x["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else -1, len(x["members"]), x["kids"], x["leaves"], x["saved"],
                   hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()) for p, x in nodes.items())


def found(df):
    got = pt.prefix_trie(df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def test_trie_equals_nested_dicts(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    rng = random.Random(2)
    rows = []
    for c in range(230):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):  # few texts: many shared prefixes, also beyond the heads
            rows.append((c + 95, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "é😀", "long text"]) if t > 5 or rng.random() < 0.3 else "same"))
    rows += [(400, t, "user", str(t % 3)) for t in range(70)] + [(401, t, "user", str(t % 3)) for t in range(67)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == truth(rows)


def test_trie_of_odd_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(7, None, None, None), (7, None, None, None), (7, 0, "user", ""), (7, 0, "user", "x"), (7, 0, None, "userx"), (None, 0, "user", "lost"), (-3, 1, "user", "n"),
            (100, 0, "user", "y" * 300_000), (163, 0, "", "only turn of its own"), (263, 0, "", "absent base"), (300, 4, "user", "z"), (300, 4, "user", "z")]
    want = truth(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want
    clash = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], SCHEMA + ", d long, name string, parent string")
    assert found(clash) == want


def test_one_conversation_alone(spark):
    rows = [(0, 0, "user", "hello")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == truth(rows)

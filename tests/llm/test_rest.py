"""Sharding, packing, WARC, toxicity, nearest neighbours and the pipeline."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from structura.llm import nn_descent, packing, queries, toxicity, warc
from structura.llm.sharding import Level, assign_shards

from .conftest import docs_df

SF = "/root/testdata/sf0.001"


def test_shards_move_only_into_the_new_one(spark, words):
    rows = [(i, words(i % 5)) for i in range(400)] + [(None, None), (3, "again"), (3, "again"), (9, "é")]
    tree = [Level("region", [Level("shard", 1.0), Level("shard", 3.0)]), Level("region", [Level("shard", 2.0), Level("shard", 0.0)])]
    got = assign_shards(docs_df(spark, rows), tree, [*tree, Level("region", [Level("shard", 2.0)])]).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert sizes[3] == 0 and 0.6 < sizes[1] / 200 < 1.4 and 0.6 < sizes[2] / 133 < 1.4 and 0.6 < sizes[0] / 67 < 1.4
    assert all(r.grown_shard in (r.shard, 4) for r in got) and any(r.grown_shard == 4 for r in got)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    nine = [r for r in got if r.text_crc32 == zlib.crc32("é".encode())]
    assert [(r.size, r.law) for r in nine] == [(3, "key")]
    assert [(r.size, r.text_crc32) for r in got if r.doc_id is None] == [(1, 0)]
    assert assign_shards(docs_df(spark, []), tree).count() == 0


def _best_fit_truth(items, capacity, per_source):
    """Every bin is looked at for every item."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - b["used"] - size, k) for k, b in enumerate(bins)
                if b["used"] + size <= capacity and b["sources"][source] < per_source and (cluster is None or cluster not in b["clusters"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "sources": Counter(), "clusters": set()})
        out.append((k, bins[k]["used"]))
        bins[k]["used"] += size
        bins[k]["sources"][source] += 1
        bins[k]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force_best_fit(seed):
    rng = random.Random(seed)
    items = sorted([(rng.randint(1, 30), rng.choice("aaab"), rng.choice([None, 1, 1, 2, 3, rng.randint(4, 50)])) for _ in range(200)], key=lambda x: -x[0])
    assert packing.pack(items, 30, 2) == _best_fit_truth(items, 30, 2)


@pytest.mark.parametrize("seed", range(4))
def test_packing_of_equal_items_equals_brute_force(seed):
    rng = random.Random(seed)
    kinds = [(rng.randint(1, 9), rng.choice("ab"), rng.choice([None, 1, 2, 3])) for _ in range(8)]
    items = sorted((rng.choice(kinds) for _ in range(500)), key=lambda x: (-x[0], str(x[2]), x[1]) if seed % 2 else (-x[0],))
    assert packing.pack(items, 12, 3) == _best_fit_truth(items, 12, 3)


def test_packing_time_grows_with_the_items():
    def took(items):
        t = time.perf_counter()
        assert len(packing.pack(items, 2_048, 4)) == len(items)
        return time.perf_counter() - t
    assert took([(1, "s", None)] * 400_000) < 20
    assert took([(10, "s", "copy")] * 100_000) < 20
    rng = random.Random(1)
    assert took(sorted(((rng.randint(1, 60), rng.choice("sssabc"), rng.randint(0, 10_000)) for _ in range(60_000)), reverse=True)) < 60


def test_many_equal_rows_are_dealt_over_the_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 500)
    monkeypatch.setattr(packing, "EQUAL_ROWS", 100)
    rows = [(None, "")] * 3_000 + [(1, "a b")] * 50 + [(i, "w " * (i % 9)) for i in range(10, 40)]
    docs = docs_df(spark, rows).selectExpr("*", "1 as tokens", "'c' as cluster", "2 as equal", "3 as salt", "4 as at")
    got = packing.pack_documents(docs, capacity=40).collect()
    assert len(got) == len(rows) and len({r.bin_id >> 32 for r in got if r.doc_id is None}) == 7
    with pytest.raises(ValueError, match="tell the rows apart"):
        packing.sequences(docs, packing.pack_documents(docs, capacity=40))


def test_packed_documents_are_whole(spark, words):
    rows = [(i, words(1 + i * 7 % 50)) for i in range(80)] + [(200, words(500)), (201, None), (202, ""), (203, ""), (None, "a b"), (5, "twice"), (5, "twice"), (300, words(39))]
    docs = docs_df(spark, rows)
    got = packing.pack_documents(docs, capacity=40, per_source=2, group_tokens=400).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin_id].append(r)
    assert sum(r.tokens for r in got) == sum(len((t or "").split()) + 1 for _, t in rows)
    long = sorted(by_doc[200], key=lambda r: r.piece)
    assert [(r.first_token, r.tokens) for r in long] == [(k * 40, min(40, 501 - k * 40)) for k in range(13)]
    texts = {i: t for i, t in rows}
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.tokens
        assert at == rs[0].bin_tokens <= 40
        assert max(Counter(f"src{(r.doc_id or 0) % 3}" for r in rs).values()) <= 2
        same = Counter(texts[r.doc_id] for r in rs if r.tokens > 1)
        assert not same or max(same.values()) == 1
    ids = [(i, t) for i, t in rows if i is not None and i != 5]
    docs, places = docs_df(spark, ids), packing.pack_documents(docs_df(spark, ids), capacity=40, group_tokens=400)
    made = " ".join(r.text for r in packing.sequences(docs, places).collect()).split()
    assert Counter(made) == Counter(w for _, t in ids for w in [*(t or "").split(), "</s>"])
    assert packing.pack_documents(docs_df(spark, [])).count() == 0


def _pages(rows, spark):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, words):
    big = words(60)
    rows = [(7, "http://a/", big), (3, "http://b/", big), (9, None, big), (4, "http://c/\r\nX: y", "short"), (5, "http://d/", "short"), (6, "http://e/", None),
            (8, "http://f/", ""), (10, "http://g/é", "é" * 50), (11, "http://h/", "é" * 50), (12, "u", "x" * 300_000), (20, "u", "WARC/1.1\r\n\r\n" * 20),
            (30, "u", big + "!"), (30, "u", big + "!"), (None, "u", big), (None, "u", "only nulls " * 20), (None, "u", "only nulls " * 20)]
    got = warc.round_trip(_pages(rows, spark)).collect()
    want = []
    ids = defaultdict(list)
    for i, _, h in rows:
        ids[h or ""].append(i)
    once = set()
    for i, _, h in rows:
        h = h or ""
        known = [x for x in ids[h] if x is not None]
        first = min(known) if known and len(h.encode()) >= 100 else None
        response = first is None or i == first and h not in once
        if i == first:
            once.add(h)
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if response else "revisit", None if response else first))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert warc.round_trip(_pages([], spark)).count() == 0


def _archive(n=6, plain=()):
    parts = []
    for i in range(n):
        body = f"page {i} ".encode() * (5 + i)
        r = warc.record(i, f"http://x/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None, False)
        parts.append(r if i in plain else warc.member(r))
    return parts


def _read(data):
    found = list(warc.salvage(data))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    return [warc._id(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)], gaps


@pytest.mark.parametrize("plain", [(), (0, 1, 2, 3, 4, 5), (1, 4)])
def test_salvage_recovers_what_is_whole(plain):
    parts = _archive(plain=plain)
    whole = b"".join(parts)
    assert _read(whole) == ([0, 1, 2, 3, 4, 5], [])
    starts = np.cumsum([0, *map(len, parts)])
    rng = random.Random(1)
    for k in range(6):
        for _ in range(8):
            at = rng.randrange(int(starts[k]), int(starts[k + 1]))
            broken = bytearray(whole)
            broken[at] ^= 1 << rng.randrange(8)
            ids, gaps = _read(bytes(broken))
            assert set(ids) >= set(range(6)) - {k}
            if k in plain:  # nothing checks the headers of a plain record
                continue
            assert ids == sorted(set(ids))
            if len(ids) == 5:
                assert gaps and gaps[0].start <= at < gaps[-1].end
        ids, gaps = _read(whole[:int(starts[k]) + 10] + whole[int(starts[k + 1]):])
        assert ids == [i for i in range(6) if i != k] and len(gaps) == 1
    junk = b"\x1f\x8b\x08junk WARC/1.0 junk"
    ids, gaps = _read(whole + junk)
    assert ids == [0, 1, 2, 3, 4, 5] and [(g.start, g.end) for g in gaps] == [(len(whole), len(whole) + len(junk))]
    assert _read(b"") == ([], []) and _read(junk)[0] == [] and _read(whole[:-1])[0] == [0, 1, 2, 3, 4]


def _plain_records(n, size=300):
    rng = random.Random(6)
    return [warc.record(i, f"http://e.com/{i}", p, len(p), hashlib.sha256(p).hexdigest(), None, False) for i, p in ((i, rng.randbytes(size)) for i in range(n))]


@pytest.mark.parametrize("level", [0, 1, 9])
def test_salvage_of_damaged_members(level):
    records = _plain_records(200)
    member = bytearray(warc.member(b"".join(records), level))
    tail = warc.member(b"".join(_plain_records(3)))
    for at in (len(member) // 3, len(member) - 4):  # inside, and in the check sum
        broken = bytearray(member)
        broken[at] ^= 0x55
        got = list(warc.salvage(bytes(broken) + tail))
        ids = [x.headers["warc-record-id"] for x in got if isinstance(x, warc.Record)]
        want = [f"<urn:page:{i}>" for i in range(200)]
        assert ids[-3:] == want[:3] and len(set(ids[:-3])) == len(ids) - 3 and set(ids) <= set(want)
        assert len(ids) - 3 >= (199 if at > len(member) - 9 or level == 0 else 60)
        assert any(isinstance(x, warc.Gap) for x in got)
    for cut in (20, 2_000):
        got = list(warc.salvage(bytes(member[:-cut]) + tail))
        assert len([x for x in got if isinstance(x, warc.Record)]) - 3 >= 200 - 1 - -(-cut // 300) * 2 and any("cut" in x.reason or "member" in x.reason for x in got if isinstance(x, warc.Gap))


def test_salvage_time_grows_with_the_bytes(monkeypatch):
    records = [bytearray(r) for r in _plain_records(40_000)]
    for r in records:
        r[-50] ^= 1
    t = time.perf_counter()
    got = list(warc.salvage(bytes(b"".join(records))))
    assert len(got) == 1 and isinstance(got[0], warc.Gap) and time.perf_counter() - t < 20
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    bomb = list(warc.salvage(warc.member(b"\0" * (1 << 24)) + warc.member(bytes(_plain_records(1)[0]))))
    assert [type(x).__name__ for x in bomb] == ["Gap", "Record"]


def test_a_lost_page_is_told(spark, tmp_path, words):
    rows = [(i, f"http://e.com/{i}", words(60)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).selectExpr("*", "1 as digest", "'g' as gap", "2 as archive")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    assert warc.read_back(pages, path).count() == 40
    for part in (tmp_path / "archives").glob("part-*"):
        data = bytearray(part.read_bytes())
        data[len(data) // 2] ^= 0xFF
        part.write_bytes(bytes(data))
    for crc in (tmp_path / "archives").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="39 records read back, 1 gaps: see (.*)") as told:
        warc.read_back(pages, path)
    gap = spark.read.parquet(str(told.value).split("see ")[1]).collect()
    assert len(gap) == 1 and gap[0].end > gap[0].start


def test_salvage_inside_one_member_and_in_spark(spark, tmp_path):
    parts = _archive(plain=range(6))
    parts[2] = parts[2].replace(b"page 2", b"page X")
    (tmp_path / "a.warc.gz").write_bytes(warc.member(b"".join(parts)))
    (tmp_path / "b.warc.gz").write_bytes(b"??" + b"".join(_archive(2)))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == [0, 0, 1, 1, 3, 4, 5]
    assert {r.gap for r in rows if r.gap} == {"in the member: wrong block digest", "no record begins here"}
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in rows if r.gap is None)


def test_toxicity_learns_on_held_out_rows(spark, words):
    rng = random.Random(2)
    bad = ["grumpf", "zorkel", "blahtz"]
    rows, labels = [], []
    for i in range(700):
        text = words(rng.randint(5, 150)).split()
        toxic = i % 4 == 0
        for _ in range(max(2, len(text) // 30) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 7:
            labels.append((i, int(toxic)))
    odd = [(2000, None), (2001, ""), (None, "Zorkel! grumpf"), (2002, "É" * 10), (2003, words(70_000)), (3, rows[3][1])]
    docs = docs_df(spark, rows + odd)
    tags = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, tags)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    held = [(r.doc_id % 4 == 0, r.predicted) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert np.mean([t == p for t, p in held]) > 0.95
    assert {r.score for r in got if r.doc_id == 2000} == {r.score for r in got if r.doc_id == 2001}
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_documents(docs_df(spark, []), toxicity.train(docs_df(spark, []), tags)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, words):
    # long texts have their telling words, short ones theirs: both must be learnt
    rows = [(i, "plain words of no note " * (1_500 if i % 4 < 2 else 3) + words(20) + (" grumpf" if i % 4 < 2 else " zorkel") * (i % 2) * 3) for i in range(160)]
    docs, tags = docs_df(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert max(len(t) for _, t in rows) > 1 << 15
    known = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    for part_bytes in (1 << 30, 1 << 19):  # one training task, several
        model = toxicity.train(docs, tags, part_bytes=part_bytes)
        got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
        assert {i for i in got if i not in known} == {i for i, r in got.items() if r.held_out}
        for kind in (0, 2):
            assert np.mean([r.predicted == i % 2 for i, r in got.items() if r.held_out and i % 4 in (kind, kind + 1)]) > 0.95


def test_toxicity_averages_changes_a_few_times(spark, words, monkeypatch):
    rows = [(i, words(400) + " grumpf" * (i % 2)) for i in range(60)]
    docs, tags = docs_df(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    rounds, one_round = [], toxicity._one_round

    def told(rows, learner, share, rates, *more):
        rounds.append(rates)
        one_round(rows, learner, share, rates, *more)

    monkeypatch.setattr(toxicity, "_one_round", told)
    every = [toxicity._pass_rate(k, 8) for k in range(8)]
    for held, n in ((toxicity.HELD_BYTES, 2), (0, 8)):  # a model is shuffled for each task and round; tasks with more rows than they hold stream them
        monkeypatch.setattr(toxicity, "HELD_BYTES", held)
        rounds.clear()
        toxicity.train(docs, tags, visits=1, part_bytes=1 << 14)
        assert len(rounds) == n and sum(rounds, []) == every


def test_toxicity_thresholds_from_counts():
    raw, labels = np.array([0.9, 0.8, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0, 0])
    low, high, n, right = np.array([0.6, 0.8, 0.2, 0.9]), np.array([0.6, 0.8, 0.4, 0.9]), np.array([1, 2, 2, 1]), np.array([1, 1, 0, 1])
    assert toxicity._best(low, high, n, right) == pytest.approx(toxicity._best(raw, raw, np.ones(6, int), labels))
    assert 0.4 < toxicity._best(low, high, n, right) < 0.6


def test_toxicity_score_does_not_depend_on_batching():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], n)).encode() for n in (0, 1, 63, 64, 65, 5000, 90_000)]
    model = toxicity.fit(texts, np.array([0, 1, 0, 1, 0, 1, 0.0]), np.zeros(7, bool))
    together = toxicity.Scorer(model)(texts)
    alone = np.array([toxicity.Scorer(model)([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def _nearest_truth(rows, k, every):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted(((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in rows if j != i))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_nearest_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(i, rows[1][1]) for i in range(300, 340)]
    rows += [(i, (np.array(rows[2][1]) * 3).tolist()) for i in range(340, 345)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 3), (1080, [None] * 8), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_descent.search(df, k=20, every=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    vectors = dict(rows)
    want = _nearest_truth(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 21))
        assert [x[2] for x in found] == pytest.approx([float(np.dot(vectors[q], vectors[j])) for _, j, _ in found])
        assert [x[1:] for x in found] == sorted([x[1:] for x in found], key=lambda x: (-x[1], x[0]))
        hits += len({x[1] for x in found} & set(want[q]))
    assert hits / (20 * len(want)) > 0.95
    assert nn_descent.search(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in nn_descent.search(few).collect()] == [(0, j) for j in _nearest_truth(rows[:3], 20, 20)[0]]


def test_vectors_of_each_length_have_their_own_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=(3, 5)[i % 2 if i % 20 else i // 20 % 2]).tolist()) for i in range(90)]
    rows.append((100, [1.0, 2.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_descent.search(df, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for size in (3, 5):
        mine = [(i, v) for i, v in rows if len(v) == size]
        want = _nearest_truth(mine, 7, 20)
        assert want and {q: got[q] for q in want} == want
    assert got.keys() == {0, 20, 40, 60, 80}  # the only vector of its length has no candidates


def test_nearest_neighbours_recall(spark):
    """Clustered and isotropic vectors, more than a block holds, against brute force."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(4000, 32)), rng.normal(size=(1, 32)) + 0.05 * rng.normal(size=(1500, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nn_descent.search(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (20 * len(got)) >= 0.9


def test_descent_reaches_what_the_start_blocks_miss(spark, monkeypatch):
    """24 times more rows than the start blocks of both trees cover: the neighbours have to come from the descent."""
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "vec_id long, embedding array<double>")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    near = nn_descent.build(df, trees=2).graph.filter("node % 10 = 0").collect()
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:24].tolist()) for i in range(0, len(x), 10)}
    assert sum(r.near in want[r.node] for r in near) / (24 * len(want)) > 0.95


def test_queries_and_pipeline_run_on_the_small_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        after = kept.count()
        assert 0 < after <= before
        before = after
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    placed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in placed.select("doc_id").distinct().collect()} == ids
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 13

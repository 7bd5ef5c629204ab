"""Token counts, N-best segmentation and lattice scores against enumeration and brute force."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from structura.llm import lattice_lm, pieces, segment
from structura.llm.lattice_batch import BatchLattice
from structura.llm.lattice_fit import UNIT, Expectation
from structura.llm.token_counts import Trie, count_tokens

from .conftest import docs_df

TOY = [("▁", -4.0), ("▁a", -2.0), ("▁ab", -3.0), ("a", -2.5), ("b", -2.2), ("ab", -3.1), ("ba", -3.3), ("bab", -4.0), ("é", -5.0)]


@pytest.fixture(scope="module")
def toy():
    rows = [(p, s, k) for k, (p, s) in enumerate(TOY)]
    return pieces.from_scores(rows, [(-8.0, 100 + b) for b in range(256)], -3.0, [p for p, _ in TOY] + [""] * 400)


@pytest.fixture(scope="module")
def real():
    return pieces.load()


def _all(v, token):
    """(score, pieces) of every segmentation."""
    n, out = len(token), []
    for k in range(n):
        for cut in combinations(range(1, n), k):
            cut = (0, *cut, n)
            score, count = 0.0, 0
            for a, b in zip(cut, cut[1:], strict=False):
                p = v.steps.get(token[a:b])
                if p is not None and not (a and token[a] == "▁"):
                    score, count = score + p, count + 1
                elif b == a + 1 and (token[a] not in v.ids or a and token[a] == "▁"):
                    score, count = score + v.spelled(token[a]), count + len(token[a].encode())
                else:
                    break
            else:
                out.append((score, count))
    return sorted(out, reverse=True)


TOKENS = ["▁", "▁a", "▁ab", "▁abab", "▁babab", "▁éb", "▁x", "▁aßb", "▁a▁b", "▁bbbbaaab", "▁abababab"]


@pytest.mark.parametrize("token", TOKENS)
def test_lattice_equals_enumeration(toy, token):
    every = _all(toy, token)
    assert toy.marginal(token) == pytest.approx(math.log(sum(math.exp(s) for s, _ in every)))
    found = segment.nbest(toy, token, 5)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in every[:5]])
    assert len({tuple(x) for _, x in found}) == len(found)
    first, second, _ = segment.two_best(toy, token)
    assert first == pytest.approx(every[0][0])
    assert second == pytest.approx(every[1][0]) if len(every) > 1 else second == -math.inf
    batch = BatchLattice(toy)
    assert batch.marginals([token, "▁a", token]).tolist() == pytest.approx([toy.marginal(token), toy.marginal("▁a"), toy.marginal(token)])
    for _, chars in batch.groups([token])[0]:
        top, next_, _, _ = batch.two_best(chars)
        assert (top[0], next_[0]) == pytest.approx((first, second))
    trie = Trie(toy)
    for _ in range(2):
        tokens, score = trie.lookup(token[1:].encode())
        assert score == pytest.approx(every[0][0])
        assert tokens == min(c for s, c in every if s == pytest.approx(every[0][0]))


def test_trie_shares_prefixes_and_long_tokens_agree(real, monkeypatch):
    rng = random.Random(1)
    some = ["".join(rng.choices("theranon", k=rng.randint(1, 40))) for _ in range(400)]
    trie, fresh = Trie(real), [Trie(real).lookup(w.encode()) for w in some]
    assert [trie.lookup(w.encode()) for w in some] == fresh
    assert len(trie.best) < 1 + sum(len(w) + 1 for w in some)
    monkeypatch.setattr("structura.llm.token_counts.LONG_TOKEN", 3)
    assert [Trie(real).lookup(w.encode()) for w in some] == fresh


def test_document_nbest_equals_whole_lattice(toy):
    codec = segment.Codec(toy)
    for text in (b"", b"ab", b"abab b ab", b"ab ab ab ab", b"x"):
        ways = [0.0]
        for w in text.split():
            ways = [a + s for a in ways for s, _ in _all(toy, "▁" + w.decode())]
        assert codec.scores(text, 4) == pytest.approx(sorted(ways, reverse=True)[:4])


TEXTS = ["", None, " \n ", "The quick brown fox", "ça été  où\tñandú", "▁mark a▁b ▁", "日本語 text 🙂", "x" * 5000, "token = \"0641917ea4e9\"", "the the the", " nbsp "]


def test_codec_round_trips(real, spark):
    codec = segment.Codec(real)
    for text in TEXTS:
        raw = (text or "").encode()
        assert codec.decode(codec.encode(raw)) == b" ".join(raw.split())
    docs = docs_df(spark, list(enumerate(TEXTS)) + [(None, "the the the"), (3, "The quick brown fox")])
    rows = segment.segment_documents(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    decoded = {r.doc_id: r.text for r in segment.decode_documents(segment.encode_documents(docs)).collect()}
    assert decoded[4] == "ça été où ñandú" and decoded[1] == ""
    counted = {r.doc_id: r for r in count_tokens(docs).collect()}
    for r in rows:
        assert r.nbest_scores[0] == pytest.approx(counted[r.doc_id].score)
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True)
    assert counted[1].n_tokens == 0 and counted[9].n_pretokens == 3
    none = docs_df(spark, [])
    assert segment.segment_documents(none).count() == count_tokens(none).count() == lattice_lm.score_documents(none).count() == 0


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def _paths(token, probs, spelled):
    """(probability, pieces and bytes) of every segmentation, from plain tables."""
    if not token:
        return [(1.0, ())]
    out = []
    for k in range(1, len(token) + 1):
        for p, rest in _paths(token[:-k], probs, spelled):
            piece = token[-k:]
            inner = len(token) > k and piece[0] == "▁"
            if piece in probs and not inner:
                out.append((p * probs[piece], (*rest, piece)))
            elif k == 1:
                own = tuple(piece.encode())
                out.append((p * math.prod(spelled[x] for x in own), (*rest, *own)))
    return out


def _fitted_truth(v, counts, ends, rounds):
    """Weights of pieces, bytes and end after ``rounds`` rounds, by enumeration."""
    given = {x: math.exp(p) for x, p in v.steps.items() if p is not None}, [math.exp(p) for p in v.byte_logp], math.exp(v.end_logp)
    probs, spelled, end = given
    for _ in range(rounds):
        found = Counter()
        for w, c in counts.items():
            every = _paths("▁" + w, probs, spelled)
            total = sum(p for p, _ in every)
            for p, path in every:
                for x in path:
                    found[x] += c * p / total
        mass = len(given[0])
        weights = {x: found[x] + mass * p for x, p in given[0].items()}
        of_byte = [found[b] + mass * p for b, p in enumerate(given[1])]
        end = ends + mass * given[2]
        total = sum(weights.values()) + sum(of_byte) + end
        probs, spelled, end = {x: w / total for x, w in weights.items()}, [w / total for w in of_byte], end / total
    return probs, spelled, end


def test_lm_base_counts_and_scores_equal_brute_force(spark, words, real):
    rows = [(i, words(1 + i % 30)) for i in range(60)] + [(100, None), (101, ""), (102, "A B a É"), (None, "the on"), (7, words(3)), (7, words(3)), (4, "▁x ☃☃y")]
    got = sorted(lattice_lm.score_documents(docs_df(spark, rows), rounds=2).collect(), key=str)
    bag = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c = Counter(w for i, ws in bag if not _held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    probs, spelled, end = _fitted_truth(real, {w.decode(): k for w, k in c.items() if w}, c[b""], 2)
    begins = end + sum(p for x, p in probs.items() if x[0] == "▁")

    def lattice(w):
        return sum(p for p, _ in _paths("▁" + w.decode(), probs, spelled)) if w else end / begins

    want = []
    for i, ws in bag:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((i, _held(i), len(ws), sum(c[w] > 0 for w in ws), n, base,
                     sum(math.log10((c[w] + v * lattice(w)) / (n + v)) for w in ws), sum(math.log10(lattice(w)) for w in ws)))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda w: str(next(x for x in got if (x.doc_id, x.n_tokens) == (w[0], w[2]) and abs(x.base_score - w[5]) < 1e-6))), strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert (g.base_score, g.score, g.lattice_score) == pytest.approx(w[5:], rel=1e-4)


def test_expected_counts_equal_enumeration(toy):
    rng = random.Random(5)
    tokens = ["▁" + "".join(rng.choice("abé▁☃") for _ in range(rng.randrange(0, 8))) for _ in range(60)]
    counts = np.array([rng.randrange(1, 2000) for _ in tokens])
    lattice = BatchLattice(toy)
    bulk = Expectation(lattice)
    bulk.add(tokens, counts)
    want, names = Counter(), {k: x for x, k in toy.ids.items()}
    for t, c in zip(tokens, counts.tolist(), strict=True):
        every = _ways(toy, t)
        total = math.log(sum(math.exp(s) for s, _ in every))
        for s, ids in every:
            for k in ids:
                want[names.get(k, k - 100)] += c * math.exp(s - total)
    got = {lattice.names[k]: bulk.taken[k] * UNIT for k in np.flatnonzero(bulk.taken)} | {int(b): bulk.spelled[b] * UNIT for b in np.flatnonzero(bulk.spelled)}
    assert {k: x for k, x in want.items() if x > 1} .keys() <= got.keys() <= want.keys()
    for k in want:
        assert got.get(k, 0) == pytest.approx(want[k], abs=0.01)
    one = Expectation(lattice)
    for t, c in zip(tokens, counts.tolist(), strict=True):
        one._one(t, c)
    assert np.abs(one.taken - bulk.taken).max() < 200 and np.abs(one.spelled - bulk.spelled).max() < 200
    long = Expectation(lattice)
    long.add(["▁" + "ab" * 5000], np.array([3]))
    units = sum(len(lattice.names[k].replace("▁", "")) * int(long.taken[k]) for k in np.flatnonzero(long.taken))
    assert units * UNIT == pytest.approx(3 * 10_000, rel=1e-3)  # every character is covered once in each of three


def test_word_probabilities_and_the_end_sum_to_one():
    v = pieces.from_scores([("▁", -1.0, 0), ("▁a", -1.2, 1), ("a", -0.5, 2), ("aa", -2.0, 3)], [(-60.0, 10 + b) for b in range(256)], -1.5, [""] * 300)
    words = [b"a" * k for k in range(200)]
    p = np.exp(lattice_lm.word_logps(BatchLattice(v), words))
    bare = math.exp(v.marginal("▁"))  # a word of no characters, which no text has
    assert p.sum() + bare == pytest.approx(1.0)


def test_lm_without_training_rows(spark):
    held = [i for i in range(100) if _held(i)][:3]
    for r in lattice_lm.score_documents(docs_df(spark, [(i, "the on") for i in held])).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score)


def _ways(v, token):
    """(score, ids) of every segmentation of a token."""
    out, n = [], len(token)
    for k in range(n):
        for cut in combinations(range(1, n), k):
            cut = (0, *cut, n)
            score, ids = 0.0, []
            for a, b in zip(cut, cut[1:], strict=False):
                p = v.steps.get(token[a:b])
                if p is not None and not (a and token[a] == "▁"):
                    score, ids = score + p, [*ids, v.ids[token[a:b]]]
                elif b == a + 1 and (token[a] not in v.ids or a and token[a] == "▁"):
                    score, ids = score + v.spelled(token[a]), ids + [v.byte_ids[c] for c in token[a].encode()]
                else:
                    break
            else:
                out.append((score, tuple(ids)))
    return out


def test_document_nbest_ids_equal_enumeration(toy):
    rng = random.Random(11)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 4)))
        every = [(0.0, ())]
        for w in text.split():
            every = [(a + s, x + ids) for a, x in every for s, ids in _ways(toy, "▁" + w)]
        every.sort(reverse=True)
        exact = dict((x, s) for s, x in every)
        for n in (1, 2, 5):
            codec = segment.Codec(toy)
            found = [(s, tuple(memoryview(ids).cast("i"))) for s, ids in codec.nbest(text.encode(), n)]
            assert [s for s, _ in found] == pytest.approx([s for s, _ in every[:n]])
            assert len({x for _, x in found}) == len(found) == min(n, len(every))
            assert all(exact[x] == pytest.approx(s) for s, x in found)
            assert found[0][1] == tuple(memoryview(codec.encode(text.encode())).cast("i"))


def test_nbest_documents_decode_to_the_words(spark):
    docs = docs_df(spark, [(1, "The tokenizers were segmenting it"), (2, ""), (3, None), (None, "naïve  naïve\tcafés"), (5, "x" * 3000)])
    ranked = segment.nbest_documents(docs, n=3)
    rows = ranked.collect()
    texts = {1: "The tokenizers were segmenting it", 2: "", 3: "", None: "naïve naïve cafés", 5: "x" * 3000}
    for doc_id, text in texts.items():
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == (3 if text else 1)
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        assert len({tuple(r.ids) for r in mine}) == len(mine)
        whole = next(r for r in segment.segment_documents(docs, n=3).collect() if r.doc_id == doc_id)
        assert whole.nbest_scores == [r.score for r in mine]
    assert {(r.doc_id, r.text) for r in segment.decode_documents(ranked).collect()} == set(texts.items())

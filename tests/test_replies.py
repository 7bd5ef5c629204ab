"""The reply store: nothing is asked twice, errors are kept, a killed run goes on."""

import os

import pytest

from structura.operators.replies import generate_missing, replies_from_store, stored_replies


def _asker(log, fail=(), die_after=None):
    """A generator that logs every prompt it gets to a file."""
    def ask(prompts):
        out = []
        for p in prompts:
            with open(log, "a") as f:
                f.write(p + "\n")
            if p in fail:
                raise ValueError(f"no answer to {p}")
            out.append("re: " + p)
        if die_after is not None and sum(1 for _ in open(log)) >= die_after:
            os._exit(1)  # the worker dies, not only the call
        return out
    return ask


def _lines(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


def test_nothing_is_asked_twice(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    prompts = spark.createDataFrame([(f"f{i}", f"p{i % 40}") for i in range(200)] + [("n", None), ("m", ""), ("n", None)], "file_id string, prompt string")
    assert {(r.response, r.error) for r in replies_from_store(prompts, store).collect()} == {(None, None)}
    generate_missing(prompts, _asker(log), store)
    got = replies_from_store(prompts, store).collect()
    assert sorted((r.file_id, r.response, r.error) for r in got) == sorted([(f"f{i}", f"re: p{i % 40}", None) for i in range(200)] + [(k, "re: ", None) for k in "nmn"])
    assert _lines(log) == sorted([f"p{i}" for i in range(40)] + [""])
    more = prompts.unionByName(spark.createDataFrame([("new", "p40"), ("new2", "p1")], "file_id string, prompt string"))
    generate_missing(more, _asker(log), store)
    assert _lines(log) == sorted([f"p{i}" for i in range(41)] + [""]) and replies_from_store(more, store).count() == 205


def test_errors_are_kept_and_calls_bounded(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "bad")], "file_id string, prompt string").coalesce(1)
    generate_missing(prompts.filter("file_id <> 'a'"), _asker(log, fail=["bad"]), store, attempts=2)
    assert [(r.calls, r.response) for r in stored_replies(spark, store).collect()] == [(2, None)]
    calls = len(_lines(log))
    generate_missing(prompts, _asker(log, fail=["bad"]), store, attempts=2)
    assert {r.file_id: (r.response, r.error) for r in replies_from_store(prompts, store).collect()} == {
        "a": ("re: good", None), "b": (None, "ValueError: no answer to bad"), "c": (None, "ValueError: no answer to bad")}
    assert len(_lines(log)) == calls + 1  # the good one; the bad one has had its calls
    generate_missing(prompts, _asker(log), store, attempts=3)
    assert {r.response for r in replies_from_store(prompts, store).collect()} == {"re: good", "re: bad"}


def test_a_run_that_ends_early_goes_on(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    prompts = spark.createDataFrame([(f"f{i}", f"p{i}") for i in range(60)], "file_id string, prompt string").coalesce(1)
    with pytest.raises(Exception):
        generate_missing(prompts, _asker(log, die_after=30), store, batches=12)
    kept = {r.response for r in stored_replies(spark, store).collect()}
    asked = _lines(log)
    assert 0 < len(kept) < 60 and len(asked) >= 30
    generate_missing(prompts, _asker(log), store, batches=12)
    again = _lines(log)
    # what was stored is not asked again
    assert all(again.count(r.removeprefix("re: ")) == 1 for r in kept)
    assert {r.response for r in replies_from_store(prompts, store).collect()} == {f"re: p{i}" for i in range(60)}

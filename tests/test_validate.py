"""The validation report: every record read and cut once, and the single rules' findings on odd URLs."""

import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from structura.functions import url as U
from structura.operators import rules as R

SCHEMA = "site_id string, pos long, url string, lastmod string, changefreq string, priority string"


def _odd_urls():
    rng = random.Random(11)
    parts = ["a", "B", "x_y", "9z", "é", "admin", "wp-admin", "adminx", "page", "2", "en", "en-us", "blog", "single-post", "a b", "a;b", "\t", " ", "", "", "%20", "products", "-"]
    ends = ["", "/", "//", "?", "?q=1", "?page=2", "?page=2&b=3", "?lang=fr", "#top", "?a=1#b", ";p=1", "\n"]
    starts = ["https://x.y", "https://x.y/", "HTTP://X.y:8/", "", "/", "//h/", " https://x.y/", "\x01\thttps://x.y/", "mailto:", "odd:/", "https://x.y/en/", "https://x.y/" + "long-" * 20]
    urls = [rng.choice(starts) + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) + rng.choice(ends) for _ in range(1500)]
    return [*dict.fromkeys(urls), None]


def _records(spark):
    rng = random.Random(12)
    dates = ["2024-02-28", "2024-02-29", "2023-02-29", "2024-13-01", "2024-00-10", "2024-1-1", "0000-01-01", "+12024-01-01", "2024-01-01 ", "2024-01-31", "2024-04-31", "", "soon", None]
    rows = [(rng.choice(["s", "t", None]), i, u, rng.choice(dates), rng.choice(["daily", "Daily", "monthly", "", None]), rng.choice(["1.0", "0.5", "0.55", "2", "-0.1", "", "high", " 0.5", None]))
            for i, u in enumerate(u for u in _odd_urls() for _ in range(rng.choice([1, 1, 2])))]
    return spark.createDataFrame(rows, SCHEMA)


def _bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_record_is_read_and_cut_once(spark, tmp_path):
    _records(spark).write.parquet(str(tmp_path / "records"))
    langs = spark.createDataFrame([("s", "fr")], "site_id string, lang string")
    pages = spark.createDataFrame([("s", 5)], "site_id string, pages long")
    report = R.sitemap_validate(spark.read.parquet(str(tmp_path / "records")), site_langs=langs, expected_pages=pages)
    plan = report._jdf.queryExecution().optimizedPlan()
    reads = [line for line in plan.collectLeaves().mkString("\n").splitlines() if "changefreq#" in line]
    assert len(reads) == 1  # all others read what was written once
    assert plan.toString().count("leading_digit") == plan.toString().count("array_distinct") == 1  # no list of findings is made again for a filter


def test_report_holds_the_single_rules_findings_on_odd_urls(spark):
    records = _records(spark).cache()
    report = R.sitemap_validate(records)
    want = R.rule_exclude(records).select("site_id", "url", "rule", "detail")
    assert _bag(report.filter("rule = 'exclude'")) == _bag(want)
    lint = R.rule_url_lint(records).select("site_id", "url", F.lit("url_style"), F.explode("violations"))
    assert _bag(report.filter("rule = 'url_style'")) == _bag(lint)
    dates = records.filter(F.try_to_date("lastmod", "yyyy-MM-dd").isNull()).select("site_id", "url", F.lit("invalid_lastmod"), "lastmod")
    assert _bag(report.filter("rule = 'invalid_lastmod'")) == _bag(dates)
    for rule, single in (("listing_detail", R.rule_listing_detail(records)), ("hierarchy", R.rule_hierarchy(records)), ("priority_order", R.rule_priority_order(records))):
        assert _bag(report.filter(F.col("rule") == rule)) == _bag(single)
    twice = records.groupBy("site_id", "url").count().filter("count > 1").count()
    assert report.filter("rule = 'duplicate'").count() == twice > 0
    for approach in R.RT.ML_APPROACHES:
        langs = spark.createDataFrame([("s", "fr"), ("s", "en"), ("u", "de")], "site_id string, lang string")
        wanted = R.rule_multilingual(records, langs, approach)
        missing = wanted.join(records.select("site_id", "url"), ["site_id", "url"], "left_anti").groupBy("site_id", "lang").count()
        want = [(r.site_id, None, "multilingual", f"{r.lang}: {r['count']} pages missing") for r in missing.collect()]
        assert _bag(R.rule_untranslated(records, langs, approach)) == sorted(want, key=repr)


def test_lists_of_exclusions_and_violations(spark):
    """Of every URL, by Python."""
    excluded = R.RT.EXCLUDED_SEGMENTS
    got = {r.url: r for r in spark.createDataFrame([(u,) for u in _odd_urls()], "url string").select(
        "url", U.url_path(F.col("url")).alias("path"), U.path_segments(F.col("url")).alias("segs"), U.segment_path(U.url_path(F.col("url"))).alias("joined"),
        R.exclusion_reasons(F.col("url"), U.path_segments(F.col("url"))).alias("reasons"), R.lint_violations(F.col("url")).alias("violations")).collect()}
    for u, r in got.items():
        if u is None:
            assert r.path is r.segs is r.joined is None
            continue
        path = urlparse(u).path
        segs = [s for s in path.split("/") if s]
        assert (r.path, r.segs, r.joined) == (path, segs, "/".join(segs))
        assert {excluded[s] for s in segs if s in excluded} <= set(r.reasons)
        checks = {"uppercase": re.search("[A-Z]", path), "underscore": "_" in path, "special_chars": re.search(r"[^A-Za-z0-9/_\-]", path), "leading_digit": any(s[0] in "0123456789" for s in segs),
                  "double_slash": "//" in path, "too_deep": len(segs) > 4, "too_long": len(u) > 100, "trailing_slash": path != "/" and path.endswith("/")}
        assert r.violations == [k for k, v in checks.items() if v]


def test_paths_without_a_language(spark):
    rows = [("", "/"), ("en", "/en"), ("en/a", "/a"), ("en-us/a/b", "/a/b"), ("en-u/a", "/en-u/a"), ("EN/a", "/EN/a"), ("a/en", "/a/en"), (None, None)]
    got = R.with_paths(spark.createDataFrame(rows, "seg_path string, want string")).collect()
    assert [r.class_path for r in got] == [r.want for r in got]
    assert [r.segs for r in got[:3]] == [[], ["en"], ["en", "a"]]

"""Ancestors by sorted partitions, against a look-up of every prefix."""

import random

from structura.functions.ancestors import with_ancestors
from structura.operators import rules as R
from structura.operators import tree as T

from .conftest import urls_df


def _prefixes(path):
    segs = path.split("/") if path else []
    return ["/".join(segs[:k]) for k in range(len(segs))]


def _expected(rows):
    known = {(s, p): v for s, p, v in rows}
    out = {}
    for s, p, v in rows:
        up = [q for q in _prefixes(p) if (s, q) in known]
        out[(s, p)] = (v, up[-1] if up else None, [known[(s, q)] for q in up])
    return out


def _check(spark, rows, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = with_ancestors(spark.createDataFrame(rows, "site_id string, path string, value long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {(r.site_id, r.path): (r.value, r.near, r.above) for r in got} == _expected(rows)
    assert len(got) == len(rows)


def test_random_trees_over_many_partitions(spark):
    rng = random.Random(5)
    names = ["a", "a-b", "a b", "b", "é", "0", "A", "a.c"]  # '-' and ' ' sort before '/', '0' behind it
    for partitions in (1, 3, 40):
        paths = {(s, "/".join(rng.choice(names) for _ in range(rng.randrange(0, 6)))) for s in ("s", "t", None) for _ in range(150)}
        rows = [(s, p, rng.choice([None, rng.randrange(1000)])) for s, p in sorted(paths, key=str)]
        _check(spark, rows, partitions)


def test_one_parent_of_most_rows_and_one_long_chain(spark):
    wide = [("s", "", 1), ("s", "p", 2)] + [("s", f"p/{k}", k) for k in range(3000)] + [("s", "p/7/x/y", 9), ("s", "p/2999/z", 8)]
    chain = [("t", "/".join(["d"] * k), k) for k in range(1, 200)]
    _check(spark, wide + chain, 16)


def test_empty_table(spark):
    assert with_ancestors(spark.createDataFrame([], "site_id string, path string, value long")).collect() == []


def test_tree_of_one_wide_parent_is_in_order(spark):
    urls = ["https://x.y/p"] + [f"https://x.y/p/{k}" for k in range(500)] + ["https://x.y/p/250/in"]
    lines = T.tree_lines(urls_df(spark, urls)).orderBy("line_no").collect()
    want = ["• p"]
    for k in range(500):
        want.append(f"  • {k}")
        if k == 250:
            want.append("    • in")
    assert [r.line for r in lines] == want and [r.line_no for r in lines] == list(range(1, 503))
    nodes = {r.path: r for r in T.graph_nodes(urls_df(spark, urls)).collect()}
    assert nodes["p/250/in"].parent_id == nodes["p/250"].node_id and nodes["p"].parent_id == "root"
    assert nodes["p"].is_folder and nodes["p/250"].is_folder and not nodes["p/1"].is_folder


def _records(spark, rows):
    return spark.createDataFrame([("s", i, f"https://x.y/{p}", "2024-01-01", "weekly", q) for i, (p, q) in enumerate(rows)],
                                 "site_id string, pos long, url string, lastmod string, changefreq string, priority string")


def test_priority_order_takes_the_nearest_page_above(spark):
    rows = [("", "0.9"), ("a", "0.5"), ("a/b/c", "0.6"), ("a/b/c/d", "0.6"), ("e", "1.0"), ("f", "high"), ("f/g", "0.9"),
            ("a", "0.4"), ("h", "0.3"), ("h/i", "2"), ("h/i/j", "0.9"), ("h/k", "0.31")]
    got = {(r.url, r.detail) for r in R.rule_priority_order(_records(spark, rows)).collect()}
    # 'a' counts with 0.5; below pages without a valid priority nothing is compared; 0.31 is read as 0.3
    assert got == {("/a/b/c", "0.6 above 0.5 of /a"), ("/e", "1.0 above 0.9 of /")}


def test_report_holds_the_checks_on_site_facts(spark):
    records = _records(spark, [("", "1.0"), ("about", "0.8")])
    langs = spark.createDataFrame([("s", "fr"), ("s", "fr"), ("t", "de")], "site_id string, lang string")
    pages = spark.createDataFrame([("s", 5), ("t", 1), ("u", 0)], "site_id string, pages long")
    traits = spark.createDataFrame([("s", True)], "site_id string, ecommerce boolean")
    industry = spark.createDataFrame([("s", sorted(R.RT.INDUSTRY_PAGES)[0])], "site_id string, industry string")
    plain = R.sitemap_validate(records).collect()
    more = R.sitemap_validate(records, site_industry=industry, site_traits=traits, site_langs=langs, expected_pages=pages).collect()
    extra = [tuple(r) for r in more if tuple(r) not in {tuple(p) for p in plain}]
    assert ("s", None, "multilingual", "fr: 2 pages missing") in extra
    assert ("s", None, "page_count", "expected 5 got 2") in extra and ("t", None, "page_count", "expected 1 got 0") in extra
    assert {r[2] for r in extra} == {"multilingual", "page_count", "industry", "legal"}
    done = _records(spark, [("", "1.0"), ("?lang=fr", "1.0")])
    assert [r for r in R.sitemap_validate(done, site_langs=langs).collect() if r.rule == "multilingual"] == []

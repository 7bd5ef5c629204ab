"""URL segments vs urllib, depth-first tree vs a Python trie, sitemap
write/parse round trip, XML fallbacks and reply extraction."""

import random
import re
import xml.etree.ElementTree as ET
from urllib.parse import urlparse

from pyspark.sql import functions as F

from structura.functions import order
from structura.operators import sitemap as S
from structura.operators import tree as T
from tests.conftest import urls_df

NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
PAGES = [("http://shop.test/", "2024-03-05", "weekly", "0.8"), ("http://shop.test/tea/green", "2024-02-11", "monthly", "0.5"),
         ("http://shop.test/tea/black?pack=2", "", "", "0.4")]


def _sitemap(pages=PAGES, root=f'<urlset xmlns="{NS}">'):
    """A sitemap on one line, with a comment, empty fields left out."""
    fields = ("loc", "lastmod", "changefreq", "priority")
    body = "".join("<url>" + "".join(f"<{f}>{v}</{f}>" for f, v in zip(fields, p, strict=True) if v) + "</url>" for p in pages)
    return S.XML_DECL + "\n" + root + "<!-- own test data -->" + body + "</urlset>"


def _docs(spark, xmls):
    return spark.createDataFrame(list(xmls.items()), "site_id string, xml string")


def test_segments_match_urlparse(spark):
    rng = random.Random(3)
    parts = ["a", "b", "", ";p=1", "?q=1", "#f", "/", "//", "x.html", " ", "%20"]
    urls = []
    for _ in range(300):
        scheme = rng.choice(["http://h.com", "https://h.com:80", "", "//h"])
        urls.append(scheme + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))))
    got = {r.url: list(r.segs) for r in T.url_segments(urls_df(spark, urls)).collect()}
    for u in urls:
        assert got[u] == [p for p in urlparse(u).path.split("/") if p], u


def _sorted_lines(urls, max_depth=6):
    """Every path prefix, sorted by where each of its own prefixes first appears."""
    paths = [tuple(x for x in urlparse(u).path.split("/") if x) for u in urls]
    first = {}
    for at, path in enumerate(paths):
        for k in range(1, len(path) + 1):
            first.setdefault(path[:k], at)
    order = sorted(first, key=lambda p: [first[p[:k]] for k in range(1, len(p) + 1)])
    return ["  " * (len(p) - 1) + "• " + p[-1] for p in order if len(p) - 1 <= max_depth]


def test_tree_lines_match_sorted_prefixes(spark):
    rng = random.Random(11)
    for trial in range(3):
        urls = ["https://e.com/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
                for _ in range(rng.randint(5, 60))]
        got = [r.line for r in T.tree_lines(urls_df(spark, urls)).orderBy("line_no").collect()]
        assert got == _sorted_lines(urls), trial
        deep = [r.line for r in T.tree_lines(urls_df(spark, urls), None).orderBy("line_no").collect()]
        assert deep == _sorted_lines(urls, 99), trial


def test_sitemap_parse_stats_and_tree(spark):
    recs = S.sitemap_parse(_docs(spark, {"s": _sitemap()}))
    assert [(r.url, r.lastmod, r.changefreq, r.priority) for r in recs.orderBy("pos").collect()] == PAGES
    st = T.page_stats(recs).first()
    assert (st.total_pages, st.main_pages, st.subpages) == (3, 1, 2)
    assert [r.line for r in T.tree_lines(recs).orderBy("line_no").collect()] == ["• tea", "  • green", "  • black"]


def test_namespace_rules_and_regex_fallback(spark):
    home = PAGES[:1]
    docs = {
        "none": _sitemap(home, "<urlset>"), "bad": _sitemap(home).replace("<!--", "<note>R&D</note><!--"), "blank": " " + _sitemap(home),
        "wrapped": S.XML_DECL + "<root>" + _sitemap(home).removeprefix(S.XML_DECL + "\n") + "</root>",
        "unused": _sitemap(home, f'<urlset xmlns:sm="{NS}">'), "foreign": _sitemap(home, '<urlset xmlns="http://other.test/">'),
        "two": _sitemap([("first</loc><loc>second", "", "", "")]), "entities": _sitemap([("a&amp;b&#38;c&#x26;d&lt;", "", "", "")]),
        "cr": "<loc>a\rb</loc> &", "separator": "<loc>a\u2028b\x85c</loc> &", "newline": "<loc>a\nb</loc> &", "empty": "",
        "image": _sitemap(home).replace("<loc>", '<i:image xmlns:i="http://i.test/"><i:loc>no</i:loc></i:image><loc>'),
    }
    by = {}
    for r in S.sitemap_parse(_docs(spark, docs)).collect():
        by.setdefault(r.site_id, []).append((r.url, r.lastmod, r.method))
    url, lastmod = PAGES[0][:2]
    assert by == {"bad": [(url, "", "regex")], "blank": [(url, "", "regex")], "wrapped": [(url, lastmod, "xml")], "two": [("first", "", "xml")],
                  "entities": [("a&b&c&d<", "", "xml")], "cr": [("a\rb", "", "regex")], "separator": [("a\u2028b\x85c", "", "regex")],
                  "image": [(url, lastmod, "xml")]}
    relaxed = S.sitemap_parse(_docs(spark, {k: docs[k] for k in ("none", "unused", "foreign")}), require_namespace=False)
    assert sorted(r.site_id for r in relaxed.collect()) == ["foreign", "none", "unused"]


def test_cdata_sections_are_text(spark):
    """Values in CDATA are read as they are, in whole or in part; in a comment or behind the root it is no text."""
    def one(loc, lastmod="", tail=""):
        return f'{S.XML_DECL}\n<urlset xmlns="{NS}"><url><loc>{loc}</loc><lastmod>{lastmod}</lastmod></url></urlset>{tail}'

    docs = {
        "whole": one("<![CDATA[https://e.com/a?x=1&y=2]]>", "<![CDATA[ 2024-01-02 ]]>"), "part": one("https://e.com/<![CDATA[a]]>&amp;<![CDATA[b]]>"),
        "entity": one("<![CDATA[a&amp;b&#38;c<loc>d</loc>\"']]>"), "comment": one("a<!-- <![CDATA[ -->b<![CDATA[<!--c-->]]>"),
        "empty": one("<![CDATA[]]>"), "brackets": one("\n  <![CDATA[a]b]]c>]]>\n"), "behind": one("a", "", "<![CDATA[]]>"),
        "prefix": one("<![CDATA[p]]>").replace("<", "<s:").replace("<s:/", "</s:").replace("<s:!", "<!").replace("<s:?", "<?").replace("xmlns=", "xmlns:s="),
    }
    by = {r.site_id: (r.url, r.lastmod, r.method) for r in S.sitemap_parse(_docs(spark, docs)).collect()}
    assert by == {"whole": ("https://e.com/a?x=1&y=2", "2024-01-02", "xml"), "part": ("https://e.com/a&b", "", "xml"),
                  "entity": ("a&amp;b&#38;c<loc>d</loc>\"'", "", "xml"), "comment": ("ab<!--c-->", "", "xml"), "empty": ("", "", "xml"),
                  "brackets": ("a]b]]c>", "", "xml"), "behind": ("a", "", "regex"), "prefix": ("p", "", "xml")}


def test_chunks_follow_each_other(spark):
    """Dense and sparse positions give the same documents, and a tree of chunked documents keeps its order."""
    urls = [f"http://shop.test/{name}" for name in "fbdaec"]
    dense = urls_df(spark, urls).withColumns({f: F.lit("") for f in ("lastmod", "changefreq", "priority")})
    sparse = dense.withColumn("pos", F.col("pos") * 40_000)
    one = [r.xml for r in S.sitemap_write(sparse).collect()]
    assert len(one) == 1 and one == [r.xml for r in S.sitemap_write(dense).collect()]
    docs = S.sitemap_write(sparse, max_urls=2)
    assert sorted((r.chunk, r.n_urls) for r in docs.collect()) == [(0, 2), (1, 2), (2, 2)]
    recs = S.sitewide_pos(S.sitemap_parse(docs, ("site_id", "chunk")))
    assert [r.url for r in recs.orderBy("pos").collect()] == urls
    assert [r.line for r in T.tree_lines(recs).orderBy("line_no").collect()] == ["• " + n for n in "fbdaec"]


def test_write_parse_round_trip(spark):
    urls = ["https://e.com/a?x=1&y=2", "https://e.com/b<c>", "https://e.com/"]
    df = urls_df(spark, urls).withColumn("lastmod", F.lit("")).withColumn("changefreq", F.lit("")) \
        .withColumn("priority", F.lit(""))
    back = S.sitemap_parse(S.sitemap_write(df).select("site_id", "xml"))
    assert [r.url for r in back.orderBy("pos").collect()] == urls


def test_extract_xml_branches(spark):
    xml = _sitemap()
    body = xml.split("\n", 1)[1]
    replies = {"fenced": f"ANALYSIS\n```xml\n{xml}\n```\nNOTES", "nodecl": f"```XML\n{body}```",
               "bare": f"Here:\n{xml}\nbye", "urlset": f"Sitemap:\n{body}\nThanks", "none": "no xml here"}
    df = spark.createDataFrame(list(replies.items()), "k string, r string")
    got = {r.k: (r.b, r.x) for r in df.select("k", S.extract_branch(F.col("r")).alias("b"),
                                             S.extract_xml(F.col("r")).alias("x")).collect()}
    assert got["fenced"] == ("fenced", xml)
    assert got["nodecl"][0] == "fenced" and got["nodecl"][1].startswith("<?xml")
    assert got["bare"] == ("declaration", xml)
    assert got["urlset"][0] == "urlset" and got["urlset"][1].startswith(S.XML_DECL)
    assert got["none"] == ("raw", "no xml here")


def test_first_edges_equal_the_whole_graph_cut(spark):
    rng = random.Random(5)
    urls = [f"https://e.com/s{i}/p{j}" for i in range(30) for j in range(10)] + [
        "https://e.com/" + "/".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    rng.shuffle(urls)
    df = urls_df(spark, urls)
    whole = T.graph_edges(T.graph_nodes(df)).filter("edge_no <= 200")
    first = T.graph_edges_top(df)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, whole.collect()))
    assert first.count() == 200 and first.orderBy("edge_no").first().from_id == "root"
    folders = T.first_graph_nodes(df).select("path", "is_folder")
    assert sorted(map(tuple, folders.collect())) == sorted(map(tuple, T.graph_nodes(df).filter("edge_no <= 200").select("path", "is_folder").collect()))


def test_tree_files_keep_sites_and_line_order(spark, tmp_path):
    """Two sites of one output name stay apart; the files give the lines in order."""
    from structura.operators.sinks import read_tree_files, write_tree_files
    urls = [f"https://e.com/{a}/{b}/{c}" for a in "pqr" for b in "xyz" for c in range(20)]
    lines = T.tree_lines(urls_df(spark, urls, site="shop").unionByName(urls_df(spark, urls[::-1], site="other")))
    names = spark.createDataFrame([("shop", "same.txt"), ("other", "same.txt")], "site_id string, output_name string")
    out = str(tmp_path / "trees")
    write_tree_files(lines, names, out, partitions=4)
    got = sorted(map(tuple, read_tree_files(spark, out).select("site_id", "line_no", "line").collect()))
    assert got == sorted(map(tuple, lines.select("site_id", "line_no", "line").collect()))


def test_sitemap_files_are_the_documents(spark, tmp_path):
    from structura.operators.sinks import read_sitemap_lines, write_sitemap_files
    rows = [(site, i * 7, f"https://e.com/{site}/{i}?a&b", "2024-01-01" if i % 2 else "", "", "0.5" if i % 3 else "") for site, n in (("big", 400), ("007", 1), ("7", 2)) for i in range(n)]
    urls = spark.createDataFrame(rows, "site_id string, pos bigint, url string, lastmod string, changefreq string, priority string")
    write_sitemap_files(urls.repartition(5), str(tmp_path / "maps"), partitions=6)
    assert len(list((tmp_path / "maps" / "site_id=big").glob("part-*"))) > 2
    got = {}
    for r in read_sitemap_lines(spark, str(tmp_path / "maps")).orderBy("site_id", "line_no").collect():
        got.setdefault(r.site_id, []).append(r.line)
    assert {k: "\n".join(v) + "\n" for k, v in got.items()} == {r.site_id: r.xml for r in S.sitemap_write(urls).collect()}


def test_tree_files_keep_ids_as_written(spark, tmp_path):
    from structura.operators.sinks import read_tree_files, write_tree_files
    ids = ["007", "7", "1e3", "2024-01-02", "", "a b/c"]
    lines = spark.createDataFrame([(s, i, f"{s}-{i}") for s in ids for i in (1, 2, 3)], "site_id string, line_no bigint, line string")
    names = spark.createDataFrame([(s, "01") for s in ids], "site_id string, output_name string")
    out = str(tmp_path / "trees")
    write_tree_files(lines, names, out)
    got = read_tree_files(spark, out).collect()
    assert sorted((r.site_id, r.line_no, r.line) for r in got) == sorted((s, i, f"{s}-{i}") for s in ids for i in (1, 2, 3))
    assert {r.output_name for r in got} == {"01"}


def test_limits_take_none(spark):
    urls = urls_df(spark, [f"https://e.com/{'/'.join('abcdefgh'[:n])}/{i}" for n in range(8) for i in range(30)])
    deep = T.graph_nodes(urls, None)
    assert deep.count() == T.tree_nodes(urls).count() > T.graph_nodes(urls).count()
    assert T.graph_edges_top(urls, None, None).count() == deep.count()
    assert T.graph_edges_top(urls, None).count() == T.graph_nodes(urls).count()
    assert T.graph_edges_top(urls, 5, None).count() == 5
    from structura.operators.prompt import prompt_context
    pairs = spark.createDataFrame([("f", i, f"q{i}", "a") for i in range(1, 71)], "file_id string, id bigint, question string, answer string")
    assert [(r.n_pairs, r.qa_text.count("Question ")) for r in prompt_context(pairs, None).collect()] == [(70, 70)]
    assert prompt_context(pairs).first().qa_text.count("Question ") == 50


def test_ranks_over_many_partitions_and_sparse_order(spark):
    from structura.functions.order import ranked
    rows = [(k, (i * 7919 % 5000) * 1_000_003) for k, n in (("hot", 5000), ("cold", 3), ("one", 1)) for i in range(n)]
    got = ranked(spark.createDataFrame(rows, "k string, o long").repartition(7), ["k"], ["o"], "at").collect()
    want = {(k, o): at for key in ("hot", "cold", "one") for at, (k, o) in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r.k, r.o): r["at"] for r in got} == want and len(got) == len(rows)


def test_tree_text_chunks_restore_the_text(spark):
    lines = T.tree_lines(urls_df(spark, [f"https://e.com/{i % 9}/{i}" for i in range(50)]))
    whole = T.tree_text(lines).first().text
    parts = T.tree_text(lines, chunk_lines=7).orderBy("chunk").collect()
    assert len(parts) > 1 and "\n".join(r.text for r in parts) == whole


# --- the tag fold against ElementTree -------------------------------------------
def _random_document(rng):
    """Nested, prefixed and redeclared elements, comments, CDATA, DOCTYPE, entities, and some faults."""
    def text():
        if rng.random() < 0.004:
            return rng.choice(["R&D", "&nbsp;", "<", "&e;"])
        return rng.choice(["a", "b &amp; c", "&#65;&#x42;", "<![CDATA[<loc>x</loc></url>]]>", "x<!-- </url> -->y", " \n ", "é😀", "<?pi x?>z", "&lt;i&gt;"])

    def attributes():
        kinds = [f' xmlns="{rng.choice([S.SITEMAP_NS, "urn:o", ""])}"', f" xmlns:s='{rng.choice([S.SITEMAP_NS, 'urn:o'])}'", " title=\"a > b xmlns='x'\"", ' t:k="v"']
        r = rng.random()
        return rng.choice(kinds) if r < 0.2 else ' zz:k="v"' if r < 0.203 else ""

    def element(depth):
        prefix = rng.choice(["", "s:", "t:"]) if rng.random() < 0.3 else ""
        name = rng.choice(["url", "url", "url", "group", "x"] if depth % 2 == 0 else ["loc", "loc", "loc", "lastmod", "priority", "changefreq", "x", "url"])
        if rng.random() < 0.12:
            return f"<{prefix}{name}{attributes()}/>"
        inner = "".join(element(depth + 1) if rng.random() < 0.6 / (1 + depth * 0.3) else text() for _ in range(rng.randint(0, 4)))
        return f"<{prefix}{name}{attributes()}>{inner}</{prefix}{name}{rng.choice(['', ' '])}>"

    def flat():
        return "<url><loc>u&amp;v</loc><priority>0.5</priority></url>"

    head = rng.choice(['<?xml version="1.0"?>\n', "", "<!-- c -->\n", "\n\n"]) if rng.random() < 0.95 else ' <?xml version="1.0"?>'
    head += rng.choice(["", "", "", "<!DOCTYPE urlset [<!ENTITY e \"ent &amp; x\"> <!-- it's ]> -->]>\n", '<!DOCTYPE urlset SYSTEM "a[b>c">\n'])
    root = rng.choice(["urlset", "urlset", "s:urlset", "url"])
    spaces = f' xmlns="{rng.choice([S.SITEMAP_NS, S.SITEMAP_NS, "urn:o"])}" xmlns:s="{rng.choice([S.SITEMAP_NS, "urn:o"])}" xmlns:t="{rng.choice([S.SITEMAP_NS, "urn:t"])}"'
    plain = rng.random() < 0.4
    body = "".join(flat() if plain and rng.random() < 0.8 else element(0) if rng.random() < 0.85 else text() for _ in range(rng.randint(0, 8)))
    tail = rng.choice(["", "\n", "<!-- t -->", "\n\n<?p i?>\n"]) if rng.random() < 0.95 else rng.choice(["x", "<a/>", "<?xml version='1.0'?>"])
    return f"{head}<{root}{spaces}>{body}</{root}>{tail}"


def _element_tree(xml):
    ns = "{%s}" % S.SITEMAP_NS
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return [(i, u.strip(), "", "", "", "regex") for i, u in enumerate(re.findall(r"<loc>(.*?)</loc>", xml))]
    value = lambda e: "" if e is None or not e.text else e.text.strip()
    return [(pos, *(value(u.find(ns + f)) for f in S.URL_FIELDS), "xml") for pos, u in enumerate(root.findall(f".//{ns}url")) if u.find(ns + "loc") is not None]


def _found(spark, docs):
    got = {k: [] for k in docs}
    for r in S.sitemap_parse(spark.createDataFrame(list(docs.items()), "site_id string, xml string").repartition(8)).collect():
        got[r.site_id].append((r.pos, r.url, r.lastmod, r.changefreq, r.priority, r.method))
    return {k: sorted(v) for k, v in got.items()}


def test_random_documents_equal_element_tree(spark):
    rng = random.Random(11)
    docs = {f"d{i}": _random_document(rng) for i in range(1_000)}
    want = {k: _element_tree(x) for k, x in docs.items()}
    assert _found(spark, docs) == want
    kinds = [w[0][-1] for w in want.values() if w]
    assert kinds.count("xml") > 300 and kinds.count("regex") > 50


def test_named_cases_equal_element_tree(spark):
    one, ns = "<url><loc>a</loc></url>", S.SITEMAP_NS
    docs = {
        "redeclared": f'<urlset xmlns="{ns}"><url xmlns="urn:other"><loc>no</loc></url>{one}</urlset>',
        "inner loc": f'<urlset xmlns="{ns}"><url><alt><loc>inner</loc></alt><loc>own</loc></url></urlset>',
        "two prefixes": f'<urlset xmlns:a="{ns}" xmlns:b="{ns}"><b:url><b:loc>1</b:loc></b:url><a:url><b:loc>2</b:loc></a:url></urlset>',
        "subset": f'<!DOCTYPE urlset [<!ENTITY who "w&amp;o">]><urlset xmlns="{ns}"><url><loc>&who;</loc><lastmod>2024-01-01</lastmod></url></urlset>',
        "empty url": f'<urlset xmlns="{ns}"><url />{one}<url/></urlset>', "no root close": f'<urlset xmlns="{ns}">{one}', "null": None,
        "blank behind": f'<urlset xmlns="{ns}">{one}</urlset>' + "\n" * 1_000_000, "blank before": "\n" * 100_000 + f'<urlset xmlns="{ns}">{one}</urlset>',
        "comments": f'<urlset xmlns="{ns}">{one}</urlset>' + "<!-- c -->\n" * 100_000, "instructions": f'<urlset xmlns="{ns}">{one}</urlset>' + "<?p i?>" * 100_000,
        "many": f'<urlset xmlns="{ns}" xmlns:i="urn:i">' + f"{one}<url><loc>b</loc><i:image><i:loc>z</i:loc></i:image></url>" * 2_000 + "</urlset>",
    }
    assert _found(spark, docs) == {k: _element_tree(x) if x is not None else [] for k, x in docs.items()}


def test_parent_of_a_path_with_a_line_separator(spark):
    rows = {r.path: r for r in T.dfs_order(T.tree_nodes(urls_df(spark, ["http://e.com/a\u2028b/c/d", "http://e.com/", "http://e.com/z;p"]))).collect()}
    assert {p: (r.parent_path, r.name, r.depth, r.line_no) for p, r in rows.items()} == {
        "a\u2028b": (None, "a\u2028b", 0, 1), "a\u2028b/c": ("a\u2028b", "c", 1, 2), "a\u2028b/c/d": ("a\u2028b/c", "d", 2, 3), "z": (None, "z", 0, 4)}


def test_nodes_move_without_what_their_path_says(spark):
    nodes = T.tree_nodes(urls_df(spark, ["http://e.com/a/b"]))
    assert T._keyed(nodes).columns == ["site_id", "path", "first_seen", "key"]
    assert "key" not in T.dfs_order(nodes).columns


def test_ranks_by_broadcast_and_by_shuffle(spark, monkeypatch, request):
    rows = spark.createDataFrame([("ab"[i % 2], i * 7919 % 1000, str(i)) for i in range(1000)], "k string, o long, v string").repartition(7)
    want = sorted((k, i, str(v)) for k in "ab" for i, (_, v) in enumerate(sorted((v * 7919 % 1000, v) for v in range(1000) if "ab"[v % 2] == k)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    for most in (order.BROADCAST_RUNS, 0):
        monkeypatch.setattr(order, "BROADCAST_RUNS", most)
        got = order.ranked(rows, ["k"], ["o"], "at", keep_order=False)
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        assert got.columns == ["k", "v", "at"] and sorted((r.k, r.at, r.v) for r in got.collect()) == want


def test_ranks_in_many_groups_need_no_table_of_all_groups(spark):
    rng = random.Random(9)
    groups = [rng.choice(["big", "big", "big", None, *(f"g{k}" for k in range(40))]) for _ in range(3000)]
    rows = [(rng.choice(["s", "t", None]), g, i, "x" * (i % 7)) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "site string, parent string, at long, more string")
    want, seen = {}, {}
    for s, p, i, _ in rows:
        if s is not None and p is not None:  # null keys were left out before, too
            want[i] = seen.get((s, p), 0)
            seen[s, p] = want[i] + 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = order.ranked_in_many(df, ["site", "parent"], ["at"], "rank")
            assert got.columns == [*df.columns, "rank"]
            assert {r.at: r["rank"] for r in got.collect()} == want and got.count() == len(want)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        ordered = T.with_sibling_idx(T.dfs_order(T.tree_nodes(urls_df(spark, [f"https://x.y/{k % 9}/{k}" for k in range(90)]))))
        assert "SortMergeJoin" not in ordered._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_read_back_lines_are_not_moved_to_their_file(spark, tmp_path):
    from structura.operators import sinks
    lines = spark.createDataFrame([("s", i, f"line {i}") for i in range(1, 301)] + [("t", 1, "one")], "site_id string, line_no long, line string")
    names = spark.createDataFrame([("s", "a.txt"), ("t", "b.txt")], "site_id string, output_name string")
    sinks.write_tree_files(lines, names, str(tmp_path / "out"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sinks.read_tree_files(spark, str(tmp_path / "out"))
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.site_id, r.output_name, r.line_no, r.line) for r in got.collect()) == sorted(
            [("s", "a.txt", i, f"line {i}") for i in range(1, 301)] + [("t", "b.txt", 1, "one")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

"""Files that many tasks share give what the whole files give."""

import random

import pytest
from pyspark.sql import functions as F

from structura.operators import sitemap as S
from structura.operators.sitemap_split import sitemap_parse_files
from structura.sources.split import placed, split_records
from structura.sources.tables import xml_texts
from tests.test_tree_sitemap import _random_document


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_places_over_many_splits(spark, tmp_path, small_splits):
    texts = {"a": [f"line {i} é" for i in range(900)], "b": ["x" * 5_000, "", "y"], "c": ["one"]}
    for k, lines in texts.items():
        (tmp_path / f"{k}.txt").write_text("\n".join(lines))
    rows, blocks = split_records(spark, str(tmp_path), "\n", file_id_re=r"/([a-z])\.txt")
    assert blocks.filter("file_id = 'a'").count() > 10
    got = placed(rows, blocks).collect()
    assert {(r.file_id, r.place): r.value for r in got} == {(k, i): x for k, lines in texts.items() for i, x in enumerate(lines)}
    assert {(r.file_id, r.total) for r in got} == {("a", 900), ("b", 3), ("c", 1)}


def test_split_sitemaps_equal_whole_texts(spark, tmp_path, small_splits):
    rng = random.Random(8)
    one = lambda i: f"<url><loc>https://e.com/{i}?a&amp;b</loc><lastmod>2024-01-01</lastmod></url>\n"
    image = '<url><loc>p</loc><i:image><i:loc>no</i:loc></i:image><!-- c --><priority> 0.5 </priority></url>'
    root = f'<?xml version="1.0"?>\n<urlset xmlns="{S.SITEMAP_NS}" xmlns:i="urn:i">\n'
    files = {"plain": root + "".join(map(one, range(400))) + "</urlset>\n", "images": root + (image + one(1)) * 80 + "<!-- end --></urlset>",
             "cut": root + "".join(map(one, range(100))), "ends with url": "".join(map(one, range(30))).strip(), "no loc": root + "<url><priority>1</priority></url>" * 40 + one(1) + "</urlset>",
             "empty": "", "commented": root + one(1) + "<!-- <url><loc>x</loc></url> -->" + one(2) + "</urlset>", "other": root.replace(S.SITEMAP_NS, "urn:x") + one(1) * 9 + "</urlset>",
             "redeclared": root + one(0) + one(1).replace("<url>", '<url xmlns="urn:x">') + one(2) + "</urlset>", "empty url": root + one(0) + "<url/>" + one(2) + "</urlset>",
             "unbound": root + one(0) + one(1).replace("loc>", "z:loc>") + "</urlset>", "entity": root + one(0) + one(1).replace("&amp;", "&nbsp;") + "</urlset>"}
    files |= {f"random{i}": _random_document(rng) for i in range(60)}
    for k, x in files.items():
        (tmp_path / f"{k.replace(' ', '_')}.xml").write_text(x)
    name = r"/([a-z_0-9]+)\.xml"
    want = S.sitemap_parse(xml_texts(spark, str(tmp_path)).withColumn("site_id", F.regexp_extract("site_id", name, 1))).collect()
    got = sitemap_parse_files(spark, str(tmp_path), file_id_re=name).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.method for r in got} == {"xml", "regex"} and sum(r.site_id == "plain" for r in got) == 400


def test_split_questionnaires_equal_whole_files(spark, tmp_path, small_splits):
    from structura.operators import ingest as I
    from structura.operators.ingest_split import parse_split, split_pairs, split_rejects, split_rows
    from structura.sources.tables import binary_files
    rng = random.Random(12)
    cell = lambda: rng.choice(["a", "", "why, so", "two\nlines", 'say ""hi""', "N/A", "x" * rng.randint(1, 300), "\n\n", "é"])
    files = {}
    for f in range(14):
        lines = "".join(",".join(f'"{cell()}"' if rng.random() < 0.7 else rng.choice(["p", "", "q r", 'in"ner']) for _ in range(rng.choice([3, 3, 3, 2, 4]))) + rng.choice(["\n", "\r\n"])
                        for _ in range(rng.randint(1, 60)))
        files[f"f{f}"] = rng.choice(["", "note\n\n", 'a "quoted\nnote\n']) + "section,question,answer\n" + lines + rng.choice(["", '"open\nto the end,', "1,q,a"])
    files |= {"none": "", "blank": " \n\n", "headeronly": "x\nsection,question,answer\n\n", "bom": "﻿section,question,answer\n1,q,a\n", "two": "question,answer\nq,a\n",
              "cross": "section,question,answer\n1," + '"' + "many\n" * 2_000 + '",a\n2,q,a\n', "swaps": "section,question,answer\n" + 'x,"y\n' * 401 + 'z",end\n1,q,a\n'}
    files |= {f"w{i}": "".join(rng.choice('ab ,"\n') for _ in range(rng.randint(0, 1_500))) for i in range(25)}
    for k, x in files.items():
        (tmp_path / f"{k}.csv").write_bytes(x.encode() if k != "f3" else ("section,question,answer\n1,\"café\n\",a\n" * 90).encode("latin-1"))
    name = r"/([a-z0-9]+)\.csv"
    whole = I.parse_files(binary_files(spark, str(tmp_path)).withColumn("file_id", F.regexp_extract("file_id", name, 1)))
    parsed = parse_split(spark, str(tmp_path), "*.csv", name)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(parsed.files.select("file_id", "encoding", "status", "header_line", "header"), whole.select("file_id", "encoding", "status", "header_line", "header"))
    assert same(split_rows(parsed), I.csv_rows(whole))
    assert same(split_rejects(parsed), I.rejects(whole))
    assert same(split_pairs(parsed), I.qa_pairs(whole)) and split_pairs(parsed).count() > 100

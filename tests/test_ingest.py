"""Questionnaire ingest: golden samples, reference quirks, round trip and a
property test against Python's csv module."""

import csv
import io
import random

from pyspark.sql import functions as F

from structura.operators import ingest as I
from tests.conftest import files_df

# A five-column questionnaire with Serbian letters (our own text).
Q5 = ("id,question,answer,category,other_info\n"
      "1,Šta nudite?,Izradu sajtova i održavanje,Usluge,nema\n"
      "2,Gde se nalazite?,U Čačku,Kontakt,\n")
# Two columns, one comma per line: no line has two commas -> header line 0.
Q2 = "question,answer\nDo you sell online?,Yes\nDo you have a blog?,No\n"


def _pairs(spark, texts, dialect="comma"):
    p = I.parse_files(files_df(spark, texts), dialect)
    return sorted(tuple(r) for r in I.qa_pairs(p).collect())


def test_golden_five_columns(spark):
    p = I.parse_files(files_df(spark, {"q5": Q5}))
    r = p.select("header_line", "header").first()
    assert r.header_line == 0
    roles = I.column_roles(p).first()
    assert (roles.q_idx, roles.a_idx) == (1, 2)
    assert _pairs(spark, {"q5": Q5}) == [("q5", 1, "Šta nudite?", "Izradu sajtova i održavanje"),
                                         ("q5", 2, "Gde se nalazite?", "U Čačku")]


def test_golden_two_columns(spark):
    p = I.parse_files(files_df(spark, {"q2": Q2}))
    assert p.select("header_line").first()[0] == 0
    assert [x[1] for x in _pairs(spark, {"q2": Q2})] == [1, 2]


def test_header_after_preamble_and_keyword_priority(spark):
    t = "Client,Acme,Ltd\n\nSection,Question,Answer\nA,What?,This\n"
    p = I.parse_files(files_df(spark, {"f": t})).first()
    assert (p.header_kw_line, p.header_any_line, p.header_line) == (2, 0, 2)


def test_long_rows_rejected_short_rows_padded_ids_not_renumbered(spark):
    t = "a,question,answer\nx,q1,a1\nx,q2,a2,EXTRA\nx,q3\nx,q4,a4\n"
    files = files_df(spark, {"f": t})
    p = I.parse_files(files)
    rej = [(r.rec_no, r.reason) for r in I.rejects(p).collect()]
    assert rej == [(1, "too_many_fields")]
    assert [(x[1], x[2]) for x in _pairs(spark, {"f": t})] == [(1, "q1"), (3, "q4")]


def test_na_tokens_drop_pairs_but_na_lowercase_kept(spark):
    t = "s,question,answer\nx,q1,N/A\nx,q2,None\nx,q3,na\nx,q4,  \n"
    assert [(x[1], x[3]) for x in _pairs(spark, {"f": t})] == [(3, "na")]


def test_header_mangling_unnamed_and_repeats(spark):
    t = "question,,answer,answer\n1,2,3,4\n"
    h = I.parse_files(files_df(spark, {"f": t})).first().header
    assert h == ["question", "Unnamed: 1", "answer", "answer.1"]


def test_python_strip_semantics(spark):
    t = "s,question,answer\nx, q1 , a1\x1c\n"
    assert _pairs(spark, {"f": t}) == [("f", 1, "q1", "a1")]


def test_latin1_fallback_and_empty_file(spark):
    t = "s,question,answer\nx,Où?,Çà\n".encode("iso-8859-1")
    files = files_df(spark, {"l": t, "e": "   \n"})
    d = {r.file_id: r.encoding for r in I.decode(files).collect()}
    assert d == {"l": "ISO-8859-1", "e": "UTF-8"}
    p = I.parse_files(files)
    assert {r.file_id: r.status for r in p.collect()} == {"l": "ok", "e": "empty"}
    assert _pairs(spark, {"l": t}) == [("l", 1, "Où?", "Çà")]


def test_unclosed_quote_keeps_rows_before(spark):
    t = 'a,question,answer\nx,q1,a1\nx,"q2,a2\nx,q3,a3\n'
    p = I.parse_files(files_df(spark, {"f": t}))
    assert [(r.reason) for r in I.rejects(p).collect()] == ["unclosed_quote"]
    assert [x[1] for x in _pairs(spark, {"f": t})] == [1]


def test_client_name_and_output_name(spark):
    t = "Client Name,question,answer\nAcme: Web/Shop,q1,a1\n,q2,a2\n"
    r = I.column_roles(I.parse_files(files_df(spark, {"f": t}))).first()
    assert r.client_name == "Acme-WebShop"
    df = spark.createDataFrame([("Acme",), ("sitemap",), (None,)], "c string")
    out = [x[0] for x in df.select(I.output_name(F.col("c"), F.to_timestamp(F.lit("2025-01-02 03:04:05"))))
           .collect()]
    assert out == ["sitemap_structure-Acme.txt", "sitemap_structure-sitemap_20250102_030405.txt",
                   "sitemap_structure-sitemap_20250102_030405.txt"]


def test_semicolon_dialect_auto(spark):
    t = 'question;answer;x\n"Why; not?";"Because\nof it";1\n'
    assert _pairs(spark, {"f": t}, "auto") == [("f", 1, "Why; not?", "Because\nof it")]


def test_records_and_cells_match_python_csv(spark):
    rng = random.Random(7)
    alphabet = "ab ,\"\n"
    texts, truth = {}, {}
    for f in range(25):
        rows = [["x" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(3)]
                for _ in range(rng.randint(1, 8))]
        buf = io.StringIO()
        w = csv.writer(buf, lineterminator="\n")
        w.writerow(["h1", "question", "answer"])
        w.writerows(rows)
        texts[f"f{f}"] = buf.getvalue()
        truth[f"f{f}"] = [tuple(r) for r in csv.reader(io.StringIO(buf.getvalue()))][1:]
    p = I.parse_files(files_df(spark, texts))
    got = {}
    for r in I.csv_rows(p).orderBy("file_id", "row_id").collect():
        got.setdefault(r.file_id, []).append(tuple(r.cells))
    assert got == truth


def test_conversation_round_trip(spark):
    from structura.sources.fixtures import qa_source, qfiles
    sf = "/root/testdata/sf0.001"
    pairs = I.qa_pairs(I.parse_files(qfiles(spark, sf)))
    assert pairs.count() == qa_source(spark, sf).count()


def test_malformed_quoting_matches_python_csv(spark):
    t = 'h,question,answer\n"abc"def,"x""y"z,plain"q\n'
    want = [tuple(r) for r in csv.reader(io.StringIO(t))][1:]
    p = I.parse_files(files_df(spark, {"f": t}))
    got = [tuple(r.cells) for r in I.csv_rows(p).orderBy("row_id").collect()]
    assert got == want == [("abcdef", 'x"yz', 'plain"q')]


def test_cells_with_many_quotes_and_records_with_many_fields(spark):
    """Patterns that recurse once per quote or field end the executor here."""
    text = "section,question,answer\n1,\"" + '""' * 1_000_000 + "\",b\n" + ",".join("x" * 100_000) + "\n2,q,a\n"
    parsed = I.parse_files(files_df(spark, {"f": text})).cache()
    assert [(r.id, len(r.question)) for r in I.qa_pairs(parsed).orderBy("id").collect()] == [(1, 1_000_000), (2, 1)]
    assert [r.reason for r in I.rejects(parsed).select("reason").collect()] == ["too_many_fields"]


def test_delimiter_is_counted_over_all_lines(spark):
    """The first twenty lines would say comma, the file says tab."""
    text = "\n".join(["a,b"] * 20 + ["x\ty\tz"] * 30)
    assert I.parse_files(files_df(spark, {"f": text}), dialect="auto").first().delimiter == "\t"


def test_files_over_the_given_limit_are_rejected(spark, tmp_path):
    from structura.sources.tables import binary_files, xml_texts
    (tmp_path / "small.csv").write_text("section,question,answer\n1,q,a\n")
    (tmp_path / "large.csv").write_text("section,question,answer\n" + "1,q,a\n" * 50)
    assert I.qa_pairs(I.parse_files(binary_files(spark, str(tmp_path)))).count() == 51
    limited = I.rejects(I.parse_files(binary_files(spark, str(tmp_path), max_bytes=100))).collect()
    assert [(r.file_id.rsplit("/", 1)[1], r.reason) for r in limited] == [("large.csv", "too_large")]
    (tmp_path / "a.xml").write_text("<x>\n</x>")
    assert [r.xml for r in xml_texts(spark, str(tmp_path / "a.xml")).collect()] == ["<x>\n</x>"]


def test_a_batch_run_again_repeats_no_pair(spark, tmp_path):
    from structura.streaming.ingest_stream import read_pairs, read_rejects, write_batch
    out = str(tmp_path / "out")
    assert read_pairs(spark, out).count() == 0
    files = files_df(spark, {"f": "section,question,answer\n1,q,a\n2,q,a,too,long\n"})
    for _ in range(2):
        write_batch(files, 0, out)
    write_batch(files_df(spark, {"g": "section,question,answer\n1,q2,a2\n"}), 1, out)
    assert sorted((r.file_id, r.question) for r in read_pairs(spark, out).collect()) == [("f", "q"), ("g", "q2")]
    assert [r.reason for r in read_rejects(spark, out).collect()] == ["too_many_fields"]


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest
    from structura.session import ensure_checkpoint_dir

    class Spark:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Spark)


def test_dialect_by_consistent_fields(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(["well,", "so", "it, is", "yes", "and;", "no"]) for _ in range(rng.randint(2, 9))).replace(";", "")
    cases = {
        "semicolon, prose with commas": ("Question, in full;Answer, in full\n" + "".join(f"{prose()};{prose()}\n" for _ in range(30)), ";", '"'),
        "same commas in every line": ("Question, in full;Answer, in full\n" + "a, b;c, d\n" * 9, ";", '"'),
        "tab": ("question\tanswer\n" + "".join(f"{prose()}\t{prose()}\n" for _ in range(9)), "\t", '"'),
        "pipe": ("section|question|answer\n" + "a, b|c; d|e, f\n" * 9, "|", '"'),
        "quoted delimiters": ('a;b\n' + '"x;y, z";"u\nv"\n' * 9, ";", '"'),
        "single quotes": ("question;answer\n" + "'x; y';'it''s; so'\n" * 9, ";", "'"),
        "one column": ("question\nwhy\nhow\n", ",", '"'), "empty": ("", ",", '"'), "comma": ("question,answer,x\n1, 2, 3\n", ",", '"'),
        "apostrophes": ("question,answer\n'tis so,yes\nwhy,'cause\nhow,so\n", ",", '"'),
    }
    parsed = I.parse_files(files_df(spark, {k: t for k, (t, _, _) in cases.items()}), dialect="auto").collect()
    assert {r.file_id: (r.delimiter, r.quote) for r in parsed} == {k: (d, q) for k, (_, d, q) in cases.items()}
    assert [list(r.cells) for r in next(r for r in parsed if r.file_id == "single quotes").rows][0] == ["x; y", "it's; so"]


def test_the_latest_version_of_a_file_counts(spark, tmp_path):
    import datetime
    from structura.streaming.ingest_stream import read_pairs, read_rejects, read_versions, start_ingest_stream, write_batch
    head = "section,question,answer\n"

    def files(rows):
        at = lambda m: datetime.datetime(2025, 1, 1, 0, m)
        return spark.createDataFrame([(i, t.encode(), at(m), p) for i, t, m, p in rows], "file_id string, content binary, modified timestamp, path string")

    out = str(tmp_path / "out")
    write_batch(files([("a", head + "1,q1,old\n1,q2,old\n", 1, "u1/a"), ("b", head + "1,q,kept\n", 5, "u1/b"), ("a", head + "1,q1,newer\n", 2, "u2/a")]), 0, out)
    now = lambda: sorted((r.file_id, r.id, r.answer) for r in read_pairs(spark, out).collect())
    assert now() == [("a", 1, "newer"), ("b", 1, "kept")]
    again = files([("a", head + "1,q1,newest\n1,x,y,z\n", 3, "u3/a"), ("b", head + "1,q,late but old\n", 4, "u3/b"), ("c", "", 1, "u3/c")])
    for _ in range(2):  # a batch that runs again changes nothing
        write_batch(again, 1, out)
        assert now() == [("a", 1, "newest"), ("b", 1, "kept")]
        assert sorted((r.file_id, r.reason) for r in read_rejects(spark, out).collect()) == [("a", "too_many_fields"), ("c", "empty")]
    assert {(r.file_id, r.path, r.batch_id) for r in read_versions(spark, out).collect()} == {("a", "u3/a", 1), ("b", "u1/b", 0), ("c", "u3/c", 1)}
    # through the stream: a second upload of the same id in a new folder
    landing, result, done = (str(tmp_path / n) for n in ("landing", "result", "done"))
    for upload, answer in (("u1", "first"), ("u2", "second")):
        folder = tmp_path / "landing" / upload
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text(head + f"1,q,{answer}\n")
        start_ingest_stream(spark, landing, result, done, file_id_re=r"/([^/]+)\.csv").awaitTermination()
        assert [r.answer for r in read_pairs(spark, result).collect()] == [answer]


def test_client_column_is_found_once_per_file(spark):
    header = "Section,Question,Answer," + ",".join(["name", "x", "name", "x", "x"])
    texts = {"a": header + "\n" + "s,q,a,http://n,1,Short Name,2,3\n" * 5, "b": "Section,Question,Answer,Client Name\ns,q,a,\ns,q,a,A/B: C\n",
             "c": "Section,Question,Answer,Name\ns,q,a," + "x" * 120 + "\n", "d": Q2}
    roles = I.column_roles(I.parse_files(files_df(spark, texts)))
    got = {r.file_id: (r.client_idx, r.client_name, r.header[3:]) for r in roles.collect()}
    assert got == {"a": (5, "Short-Name", ["name", "x", "name.1", "x.1", "x.2"]), "b": (3, "AB-C", ["Client Name"]),
                   "c": (None, "sitemap", ["Name"]), "d": (None, "sitemap", [])}
    parsed = spark.createDataFrame([], "header array<string>, rows array<struct<row_id:long,rec_no:long,cells:array<string>>>")
    said = parsed.select(I._client(F.col("header"), F.col("rows")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert said.count("lower(") <= 2  # was worked out again for the index of every row's cell

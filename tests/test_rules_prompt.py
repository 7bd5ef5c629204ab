"""Rule operators on a small literal page set (one or two URLs per rule),
prompt assembly, batch generation and the driver contract."""

import math
import re

from pyspark.sql import functions as F

from structura.operators import prompt as M
from structura.operators import rules as R
from tests.conftest import urls_df

H = "https://site.example.com"
RULE_PAGES = [
    H + "/", H + "/about", H + "/contact", H + "/admin", H + "/wp-admin/edit", H + "/my-account",
    H + "/search?q=shoes", H + "/products?category=tv", H + "/blog/page/2", H + "/news?page=3",
    H + "/en/", H + "/form-submit", H + "/analytics", H + "/blog", H + "/news", H + "/news/single-news",
    H + "/products", H + "/products/tv/oled/sony/x1", H + "/privacy-policy", H + "/Services/Web_Dev",
    H + "/a//b", H + "/1st-page", H + "/trail/", H + "/" + "x" * 120, H + "/about", H + "/tag/sale",
]


def test_exclusions(spark):
    got = {(r.url, r.detail) for r in R.rule_exclude(urls_df(spark, RULE_PAGES)).collect()}
    want = {(H + "/admin", "admin"), (H + "/wp-admin/edit", "admin"), (H + "/my-account", "account"),
            (H + "/search?q=shoes", "search"), (H + "/products?category=tv", "filter"),
            (H + "/blog/page/2", "pagination"), (H + "/news?page=3", "pagination"),
            (H + "/en/", "language_prefix"), (H + "/form-submit", "form_endpoint"),
            (H + "/analytics", "technical_feature")}
    assert got == want


def test_listing_detail_and_hierarchy(spark):
    u = urls_df(spark, RULE_PAGES)
    ld = {(r.url, r.detail) for r in R.rule_listing_detail(u).collect()}
    assert ld == {("/blog", "missing /blog/single-post"), ("/products", "missing /products/single-product")}
    h = {(r.url, r.detail) for r in R.rule_hierarchy(u).collect()}
    assert ("/products/tv/oled/sony/x1", "too_deep: 5 levels") in h
    assert ("/products/tv/oled/sony/x1", "orphan: missing /products/tv/oled/sony") in h
    assert ("/news/single-news", "orphan: missing /news") not in h


def test_industry_legal_multilingual(spark):
    u = urls_df(spark, RULE_PAGES)
    ind = spark.createDataFrame([("s", "saas")], "site_id string, industry string")
    assert {r.url for r in R.rule_industry(u, ind).collect()} == {"/features", "/pricing", "/documentation", "/use-cases"}
    tr = spark.createDataFrame([("s", True, False, True, False)],
                               "site_id string, collects_data boolean, ecommerce boolean, eu_audience boolean, "
                               "professional boolean")
    legal = {(r.url, r.detail) for r in R.rule_legal(u, tr).collect()}
    assert legal == {("/cookie-policy", "eu_audience")}
    langs = spark.createDataFrame([("s", "de"), ("s", "fr")], "site_id string, lang string")
    ml = R.rule_multilingual(urls_df(spark, [H + "/about", H + "/"]), langs, "subdirectory")
    assert {r.url for r in ml.collect()} == {H + "/de/about", H + "/fr/about", H + "/de/", H + "/fr/"}
    ml = R.rule_multilingual(urls_df(spark, [H + "/about"]), langs)
    assert {r.url for r in ml.collect()} == {H + "/about?lang=de", H + "/about?lang=fr"}


def test_priority_changefreq_lastmod(spark):
    a = {r.url: r for r in R.apply_rules(urls_df(spark, RULE_PAGES), "2025-01-31").collect()}
    assert str(a[H + "/"].priority) == "1.0" and str(a[H + "/"].lastmod) == "2025-01-31"
    assert (str(a[H + "/products"].priority), a[H + "/products"].changefreq) == ("0.9", "daily")
    assert str(a[H + "/about"].priority) == "0.8"
    assert (str(a[H + "/blog"].priority), a[H + "/blog"].changefreq) == ("0.7", "daily")
    assert str(a[H + "/news/single-news"].priority) == "0.5"
    assert (str(a[H + "/privacy-policy"].priority), a[H + "/privacy-policy"].changefreq) == ("0.4", "monthly")
    assert str(a[H + "/tag/sale"].priority) == "0.3"
    assert str(a[H + "/privacy-policy"].lastmod) >= "2024-08-04"
    assert len({str(r.lastmod) for r in a.values()}) > 5


def test_url_lint(spark):
    got = {r.url: list(r.violations) for r in R.rule_url_lint(urls_df(spark, RULE_PAGES)).collect()}
    assert got[H + "/Services/Web_Dev"] == ["uppercase", "underscore"]
    assert got[H + "/a//b"] == ["double_slash"]
    assert got[H + "/1st-page"] == ["leading_digit"]
    assert got[H + "/trail/"] == ["trailing_slash"]
    assert got[H + "/" + "x" * 120] == ["too_long"]
    assert got[H + "/products/tv/oled/sony/x1"] == ["too_deep"]
    assert H + "/about" not in got


def test_validate(spark):
    recs = (R.apply_rules(urls_df(spark, RULE_PAGES), "2025-01-31")
            .select("site_id", "pos", "url", F.col("lastmod").cast("string").alias("lastmod"),
                    F.when(F.col("url").endswith("/contact"), F.lit("hourly")).otherwise(F.col("changefreq"))
                    .alias("changefreq"),
                    F.when(F.col("url").endswith("/blog"), F.lit("2")).otherwise(F.col("priority").cast("string"))
                    .alias("priority")))
    rules = {(r.url, r.rule) for r in R.sitemap_validate(recs).collect()}
    assert (H + "/about", "duplicate") in rules
    assert (H + "/blog", "invalid_priority") in rules
    assert (H + "/contact", "changefreq") in rules
    assert (H + "/admin", "exclude") in rules and ("/blog", "listing_detail") in rules


def test_profile_and_planned_pages(spark):
    pairs = spark.createDataFrame([
        ("f", 1, "What do you sell?", "An online shop with products and a cart"),
        ("f", 2, "Do you write?", "Yes, a blog and news; GDPR applies"),
        ("g", 1, "Hello", "World")], "file_id string, id bigint, question string, answer string")
    p = {r.file_id: r for r in R.questionnaire_profile(pairs).collect()}
    assert p["f"].business_type == "ecommerce" and p["f"].ecommerce
    assert list(p["f"].dynamic_types) == ["blog", "news", "products"]
    assert list(p["f"].legal_pages) == ["cookie-policy", "privacy-policy", "terms-and-conditions"]
    assert p["g"].business_type == "general" and list(p["g"].dynamic_types) == []
    pages = {r.path for r in R.planned_pages(R.questionnaire_profile(pairs)).filter("file_id = 'f'").collect()}
    assert {"", "blog", "blog/single-post", "products/single-product", "shipping-information"} <= pages
    xml = M.rule_based_replies(pairs, "2025-01-31").filter("file_id = 'g'").first().response
    assert xml.startswith("```xml") and "<loc>https://example.com/about</loc>" in xml


def test_prompt_context_cap_and_suffix(spark):
    rows = [("f", i, f"q{i}", f"a{i}") for i in range(1, 54)] + [("g", 1, "q", "a")]
    pairs = spark.createDataFrame(rows, "file_id string, id bigint, question string, answer string")
    ctx = {r.file_id: r for r in M.prompt_context(pairs).collect()}
    f = ctx["f"].qa_text
    assert f.startswith("Question 1: q1\nAnswer: a1\n\nQuestion 2:")
    assert "Question 50: q50" in f and "Question 51" not in f
    assert f.endswith("\n\n... and 3 more question-answer pairs.") and ctx["f"].n_pairs == 53
    assert ctx["g"].qa_text == "Question 1: q\nAnswer: a"
    pr = M.prompt_render(M.prompt_context(pairs), "2025-01-31").filter("file_id = 'g'").first().prompt
    assert "Date: 2025-01-31" in pr and pr.count("Question 1: q\nAnswer: a") == 1


def test_generate_batch_captures_errors(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "boom"), ("c", "fine")], "file_id string, prompt string").coalesce(1)

    def gen(prompts):
        if "boom" in prompts:
            raise RuntimeError("model down")
        return [p.upper() for p in prompts]
    got = {r.file_id: (r.response, r.error) for r in M.generate_batch(df, gen).collect()}
    assert got == {"a": ("OK", None), "b": (None, "RuntimeError: model down"), "c": ("FINE", None)}


def test_class_values_agree_within_a_class():
    assert len({row[0] for row in R.RT.PAGE_CLASSES}) == len(R.RT.PAGE_CLASSES)


def test_driver_contract(spark):
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 50
    df = E.entry(spark)
    assert df.columns == ["site_id", "line_no", "depth", "line"] and df.count() > 1000


def test_mentioned_pages_and_refusals(spark):
    from structura.operators import rules as R
    rows = [("f", 1, "Which pages do you want?", "A blog, case results and an About us page."), ("f", 2, "Do you need a gallery?", "No, thanks."),
            ("f", 3, "Anything else?", "We have no menu. Pricing is a must; without any shipping information"), ("f", 4, "And a team page?", "Yes, the team"),
            ("g", 1, "Languages?", "Use a subdomain, not a language folder"), ("g", 2, "Sure?", "Subdomains. Contact form too"), ("h", 1, "Terms and conditions?", "no"),
            ("i", 1, "x", "Blogging and newsroom"), ("n", 1, None, "privacy policy"), ("j", 1, "No.", "Blog, cookie  policy")]
    pairs = spark.createDataFrame(rows, "file_id string, id bigint, question string, answer string")
    got = {}
    for r in R.mentioned(pairs, R.RT.PAGE_PHRASES | {p: f"={a}" for p, a in R.RT.APPROACH_PHRASES.items()}).collect():
        got.setdefault(r.file_id, set()).add(r.value)
    assert got == {"f": {"blog", "case-results", "about", "pricing", "team"}, "g": {"=subdomain", "contact"}, "n": {"privacy-policy"}, "j": {"blog", "cookie-policy"}}
    details = {r.file_id: r for r in R.profile_details(pairs, R.questionnaire_profile(pairs)).collect()}
    assert details["g"].language_approach == "subdomain" and details["f"].language_approach is None
    assert details["f"].explicit_pages == ["about", "blog", "case-results", "pricing", "team"] and details["i"].explicit_pages == []
    assert "blog" in details["f"].implied_pages and details["f"].industry == "restaurant" and details["i"].industry == "general"


def test_orphans_of_a_missing_parent_with_many_children(spark):
    from structura.operators import rules as R
    urls = [f"https://e.com/gone/c{i}" for i in range(3_000)] + ["https://e.com/here", "https://e.com/here/x", "https://e.com/a/b/c/d"]
    df = spark.createDataFrame([("s", i, u) for i, u in enumerate(urls)], "site_id string, pos bigint, url string")
    got = [(r.url, r.detail) for r in R.rule_hierarchy(df).collect()]
    assert sorted(got) == sorted([(f"/gone/c{i}", "orphan: missing /gone") for i in range(3_000)] + [("/a/b/c/d", "orphan: missing /a/b/c"), ("/a/b/c/d", "too_deep: 4 levels")])


def _evidence_truth(files, vocab):
    """Weights by going over all files for each keyword."""
    out = {}
    for token, (signal, value) in vocab.items():
        peers = {t for t, sv in vocab.items() if sv == (signal, value) and t != token}
        total = len(files)
        n = sum(token in words for words in files)
        backing = [words for words in files if words & peers]
        both = sum(token in words for words in backing)
        share = (n + 0.5) / (total + 1)
        p = (both + share) / (len(backing) + 1)
        weight = math.log((total + 1) / (n + 1)) + math.log(p / (1 - p)) - math.log(share / (1 - share))
        out[token] = (signal, value, n, both, round(max(0.0, weight) * 1_000_000))
    return out


def test_words_of_every_file_stop_deciding(spark):
    vocab = {"shop": ("business_type", "ecommerce"), "store": ("business_type", "ecommerce"), "dental": ("business_type", "medical"),
             "clinic": ("business_type", "medical"), "studio": ("business_type", "agency"), "saas": ("business_type", "saas"),
             "form": ("trait", "collects_data"), "blog": ("dynamic", "blog")}
    files = [["shop form", "shop now", "a shop"] for _ in range(30)]
    files[0] += ["dental care", "blog"]
    files[1] += ["Clinic, dental"]
    files[2] += ["studio saas"]
    files[3] = ["nothing here"]
    rows = [(f"f{k}", i, text, "") for k, texts in enumerate(files) for i, text in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "file_id string, id long, question string, answer string")
    counts = R.keyword_counts(pairs, vocab)
    weights = R.evidence_weights(counts, vocab)
    got = {r["token"]: (r["signal"], r["value"], r["n_files"], r["n_backed"], r["weight"]) for r in weights.collect()}
    assert got == _evidence_truth([{w for t in texts for w in re.split(r"\W+", t.lower())} for texts in files], vocab)
    assert got["shop"][4] < 50_000 < 2_000_000 < got["dental"][4] and got["store"][2] == 0

    by_count = {r["file_id"]: r for r in R.questionnaire_profile(pairs, vocab).collect()}
    found = {r["file_id"]: r for r in R.weighted_profile(counts, weights).collect()}
    assert set(found) == set(by_count) == {f"f{k}" for k in range(30)}
    assert by_count["f0"]["business_type"] == "ecommerce" and found["f0"]["business_type"] == "medical"
    assert found["f0"]["evidence"] == got["dental"][4] and found["f0"]["n_pairs"] == 5 and found["f0"]["dynamic_types"] == ["blog"]
    assert found["f2"]["business_type"] == "agency"  # as much for each of two types: by name
    assert found["f5"]["business_type"] == "general" and found["f5"]["evidence"] == 0
    assert by_count["f5"]["traits"] == ["collects_data", "ecommerce"] and found["f5"]["traits"] == []
    assert found["f3"]["business_type"] == "general" and found["f3"]["legal_pages"] == []

    none = R.keyword_counts(pairs.limit(0), vocab)
    assert {r["weight"] for r in R.evidence_weights(none, vocab).collect()} == {0}
    assert R.weighted_profile(none, R.evidence_weights(none, vocab)).count() == 0


def test_keywords_that_go_together_weigh_more(spark):
    vocab = {"shop": ("business_type", "ecommerce"), "store": ("business_type", "ecommerce"), "dental": ("business_type", "medical"),
             "clinic": ("business_type", "medical")}
    # each word in ten of forty files: shop and store with each other, dental and clinic apart
    files = [["shop store"]] * 10 + [["dental"]] * 10 + [["clinic"]] * 10 + [["else"]] * 10
    rows = [(f"f{k}", 0, texts[0], None) for k, texts in enumerate(files)]
    pairs = spark.createDataFrame(rows, "file_id string, id long, question string, answer string")
    got = {r["token"]: r["weight"] for r in R.evidence_weights(R.keyword_counts(pairs, vocab), vocab).collect()}
    assert got["shop"] == got["store"] > got["dental"] == got["clinic"]


def _counting(spark, df):
    """``df`` and an accumulator of how many of its rows were worked out."""
    done = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            done.add(len(b))
            yield b
    return df.mapInPandas(run, df.schema), done


def test_prompt_context_reads_its_pairs_once(spark):
    rows = [("f", i, f"q{i}", f"a{i}") for i in range(1, 61)] + [("g", 1, "q", "a")]
    pairs, done = _counting(spark, spark.createDataFrame(rows, "file_id string, id long, question string, answer string"))
    got = {r.file_id: r for r in M.prompt_context(pairs).collect()}
    assert got["f"].n_pairs == 60 and got["f"].qa_text.endswith("\n\n... and 10 more question-answer pairs.")
    assert got["g"].qa_text == "Question 1: q\nAnswer: a" and done.value == len(rows)


def test_file_facts_parse_every_file_once(spark):
    from structura.operators import results
    from structura.operators.ingest import parse_files
    from tests.conftest import files_df
    texts = {"a": "Section,Question,Answer,Client Name\ns,q,a,Acme Inc\ns,r,b,\n", "b": "", "c": "Section,Question,Answer\ns,q,a\n"}
    files, done = _counting(spark, files_df(spark, texts))
    got = {r.file_id: r for r in results.file_facts(parse_files(files)).collect()}
    assert {k: (r.status, r.n_rows, r.client_name) for k, r in got.items()} == {
        "a": ("ok", 2, "Acme-Inc"), "b": ("empty", 0, None), "c": ("ok", 1, "sitemap")}
    assert done.value == len(texts)
    twice = results.file_facts(parse_files(files_df(spark, texts).unionByName(files_df(spark, {"a": texts["a"]}))))
    assert twice.count() == 6  # a repeated id meets every row of its id, as it does in the SQL


def test_replies_in_one_file_are_parsed_by_many_tasks(spark):
    from structura.operators import results
    xml = "```xml\n<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"><url><loc>https://x.y/{}</loc></url></urlset>\n```"
    replies = spark.createDataFrame([(str(i), xml.format(i), None) for i in range(40)], "file_id string, response string, error string").coalesce(1)
    records = results.site_records(replies)
    assert records.rdd.getNumPartitions() > 1 and records.count() == 40

"""Site-structure rules V1-V12 over URL-record tables.

Input URL tables have ``site_id, pos, url`` (and, for validation,
``lastmod, changefreq, priority``).  Findings share one schema,
``site_id, url, rule, detail``, so a report is a plain union.

Per-URL rules (exclusions, page class, priority, changefreq, lastmod, URL
style) are projections: rule tables become literal maps and ``CASE``
chains, so they add no shuffle.  Rules about the *set* of pages of a site
(missing detail pages, orphans, industry and legal pages) are anti joins on
``(site_id, path)``; the hash of the path spreads one large site over many
tasks.  Site-level side tables (industries, traits, languages) are
left to the planner, which knows their size at run time.
"""

from __future__ import annotations

import datetime as _dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ancestors import with_ancestors
from ..functions.scratch import materialize
from ..functions.settle import settled
from ..functions.url import clean_url, path_segments, segment_path, url_path
from . import rule_tables as RT

FINDING_COLS = ("site_id", "url", "rule", "detail")
QUERY_RE = r"\?([^#]*)"
HOST_PART_RE = r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])


def _lang_free(seg_path: Column) -> Column:
    """Joined segments without a leading language code (``en/blog`` -> ``blog``; ``en`` alone stays)."""
    first = F.substring_index(seg_path, "/", 1)
    return F.when(F.contains(seg_path, F.lit("/")) & first.rlike(RT.LANG_CODE_RE),
                  F.substring(seg_path, F.length(first) + 2, F.length(seg_path))).otherwise(seg_path)


def cut_segments(seg_path: Column) -> Column:
    """The segments of ``seg_path``; none for ''."""
    return F.when(seg_path == "", F.array().cast("array<string>")).otherwise(F.split(seg_path, "/"))


def with_paths(urls: DataFrame) -> DataFrame:
    """Adds ``segs``, ``seg_path`` ('a/b') and ``class_path`` ('/a/b', '/' for the homepage,
    language prefix removed).  A ``seg_path`` that ``urls`` has is taken as it is, and no URL is read."""
    p = urls
    if "seg_path" not in urls.columns:
        p = p.withColumn("__path", url_path(F.col("url"))).withColumn("__joined", segment_path(F.col("__path")))
        # a generator, as in with_class: a filter on the path would cut the URL again for each mention of it
        p = p.select(*urls.columns, F.explode_outer(F.array("__joined")).alias("seg_path"))
    return (p.withColumn("segs", cut_segments(F.col("seg_path")))
            .withColumn("class_path", F.concat(F.lit("/"), _lang_free(F.col("seg_path")))))


def _finding(df: DataFrame, url: Column, rule: str, detail: Column) -> DataFrame:
    return df.select("site_id", url.alias("url"), F.lit(rule).alias("rule"), detail.alias("detail"))


# V1 --------------------------------------------------------------------------
def exclusion_reasons(url: Column, segs: Column, approach: str = RT.ML_DEFAULT) -> Column:
    """ARRAY<STRING> of the reasons a URL is not a page (empty when it is)."""
    seg_reasons = F.filter(F.transform(segs, lambda s: F.try_element_at(_lit_map(RT.EXCLUDED_SEGMENTS), s)),
                           lambda r: r.isNotNull())
    query = F.regexp_extract(clean_url(url), QUERY_RE, 1)
    params = F.filter(F.split(query, "&"), lambda p: p != "")
    search = F.exists(params, lambda p: p.startswith("q="))
    paged = F.exists(params, lambda p: p.rlike(r"^page=[0-9]+$"))
    other = F.exists(params, lambda p: ~p.startswith("q=") & ~p.rlike(r"^page=[0-9]+$"))
    pagination = paged | F.array_join(segs, "/").rlike(RT.PAGINATION_RE)
    lang_prefix = (F.size(segs) == 1) & F.get(segs, 0).rlike(RT.LANG_CODE_RE)
    flags = F.array(F.when(search, F.lit("search")), F.when(other, F.lit("filter")),
                    F.when(pagination, F.lit("pagination")),
                    F.when(lang_prefix & F.lit(approach != "subdirectory"), F.lit("language_prefix")))
    both = F.concat(seg_reasons, F.filter(flags, lambda r: r.isNotNull()))
    rank = _lit_map({r: i for i, r in enumerate(RT.EXCLUDE_REASONS)})
    return F.array_sort(F.array_distinct(both),
                        lambda a, b: (F.element_at(rank, a) - F.element_at(rank, b)).cast("int"))


def rule_exclude(urls: DataFrame, approach: str = RT.ML_DEFAULT) -> DataFrame:
    """V1: one finding per (URL record, reason)."""
    segs = path_segments(F.col("url"))
    r = urls.select("site_id", "pos", "url", F.explode(exclusion_reasons(F.col("url"), segs, approach))
                    .alias("reason"))
    return r.select("site_id", "pos", "url", F.lit("exclude").alias("rule"), F.col("reason").alias("detail"))


# V2 / V3 ---------------------------------------------------------------------
def site_paths(urls: DataFrame) -> DataFrame:
    """Distinct ``(site_id, seg_path)`` of a URL table (partial aggregation)."""
    return with_paths(urls).select("site_id", "seg_path").distinct()


def rule_listing_detail(urls: DataFrame) -> DataFrame:
    """V2: listing pages whose detail-page template is missing."""
    paths = site_paths(urls)
    last = F.substring_index("seg_path", "/", -1)
    listing = (paths.withColumn("detail_seg", F.try_element_at(_lit_map(dict(RT.LISTING_DETAIL)), last))
               .filter(F.col("detail_seg").isNotNull())
               .withColumn("expected", F.concat_ws("/", "seg_path", "detail_seg")))
    # only a path that ends as a template does can be one that a listing expects
    existing = paths.filter(last.isin(*(b for _, b in RT.LISTING_DETAIL))).select("site_id", F.col("seg_path").alias("expected"))
    missing = listing.join(existing, ["site_id", "expected"], "left_anti")
    return _finding(missing, F.concat(F.lit("/"), F.col("seg_path")), "listing_detail",
                    F.concat(F.lit("missing /"), F.col("expected")))


def rule_hierarchy(urls: DataFrame, max_levels: int = RT.MAX_LEVELS) -> DataFrame:
    """V3: orphans (parent path absent from the site) and pages deeper than
    ``max_levels``."""
    paths = (with_paths(urls).filter(F.col("seg_path").isNotNull()).select("site_id", F.col("seg_path").alias("path"), F.lit(None).alias("value")).distinct())
    return _hierarchy(with_ancestors(paths), max_levels)


def _hierarchy(paths: DataFrame, max_levels: int) -> DataFrame:
    """V3 findings of paths with their nearest ancestor: each path is read once, both findings come from its row."""
    n = F.when(F.col("path") == "", F.lit(0)).otherwise(F.size(F.split("path", "/")))
    parent = F.left(F.col("path"), F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1)
    found = F.array(F.when((F.col("n") >= 2) & ~F.col("near").eqNullSafe(F.col("parent")), F.concat(F.lit("orphan: missing /"), F.col("parent"))),
                    F.when(F.col("n") > max_levels, F.concat(F.lit("too_deep: "), F.col("n").cast("string"), F.lit(" levels"))))
    rows = (paths.select("site_id", "path", "near", n.alias("n"), parent.alias("parent"))
            .select("site_id", "path", F.explode(found).alias("detail")).filter(F.col("detail").isNotNull()))
    return _finding(rows, F.concat(F.lit("/"), F.col("path")), "hierarchy", F.col("detail"))


def _priority_paths(records: DataFrame) -> DataFrame:
    """Distinct paths with their nearest ancestor; ``value``: ten times the greatest valid priority of the path's records."""
    rows = with_paths(records).withColumn("value", _valid_priority()).filter(F.col("seg_path").isNotNull())
    return _nearest(rows)


def _valid_priority() -> Column:
    """Ten times ``priority``, null for one that is no number from 0 to 1."""
    prio = F.col("priority").try_cast("decimal(2,1)")
    return F.when((prio >= 0) & (prio <= 1), (prio * 10).cast("long"))


def _nearest(rows: DataFrame) -> DataFrame:
    """Distinct paths of rows ``site_id, seg_path, value`` with their nearest ancestor and greatest ``value``."""
    return with_ancestors(rows.groupBy("site_id", F.col("seg_path").alias("path")).agg(F.max("value").alias("value")))


def _outranking(paths: DataFrame) -> DataFrame:
    own, up = F.col("value"), F.try_element_at("above", F.lit(-1))

    def shown(value: Column) -> Column:
        return (value / 10).cast("decimal(2,1)").cast("string")

    return _finding(paths.filter(own > up), F.concat(F.lit("/"), F.col("path")), "priority_order",
                    F.concat(shown(own), F.lit(" above "), shown(up), F.lit(" of /"), F.col("near")))


def rule_priority_order(records: DataFrame) -> DataFrame:
    """Pages that outrank their nearest existing ancestor (``records``: ``site_id, url, priority`` as text).

    A path's priority is the greatest valid one of its records; the
    homepage is an ancestor of all.  A path or nearest ancestor without a
    valid priority gives no finding here.
    """
    return _outranking(_priority_paths(records))


# V4 / V5 ---------------------------------------------------------------------
def _class_paths(urls: DataFrame) -> DataFrame:
    """Distinct language-free paths per site, without the leading '/'."""
    return (with_paths(urls).select("site_id", F.substring("class_path", 2, 1 << 30).alias("path"))
            .distinct())


def _missing(expected: DataFrame, urls: DataFrame, rule: str, pages: list[str]) -> DataFrame:
    """``expected`` pages, all of them among ``pages``, that ``urls`` lack."""
    there = _class_paths(urls).filter(F.col("path").isin(*pages))
    miss = expected.join(there, ["site_id", "path"], "left_anti")
    return _finding(miss, F.concat(F.lit("/"), F.col("path")), rule, F.col("why"))


def rule_industry(urls: DataFrame, site_industry: DataFrame) -> DataFrame:
    """V4: pages the site's industry needs (``site_industry: site_id, industry``)."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, p) for i, ps in RT.INDUSTRY_PAGES.items() for p in ps],
                                  "industry string, path string")
    expected = (site_industry.join(F.broadcast(table), "industry")
                .select("site_id", "path", F.col("industry").alias("why")))
    return _missing(expected, urls, "industry", sorted({p for ps in RT.INDUSTRY_PAGES.values() for p in ps}))


def rule_legal(urls: DataFrame, site_traits: DataFrame) -> DataFrame:
    """V5: legal pages required by the traits (``site_traits``: ``site_id`` and
    one BOOLEAN column per trait), unpivoted, joined to the rule table and
    de-duplicated per page."""
    spark = urls.sparkSession
    traits = [c for c in site_traits.columns if c != "site_id"]
    long = (site_traits.unpivot("site_id", traits, "trait", "has").filter(F.col("has")))
    table = spark.createDataFrame(RT.LEGAL_PAGES, "trait string, path string")
    expected = (long.join(F.broadcast(table), "trait")
                .groupBy("site_id", "path").agg(F.array_join(F.sort_array(F.collect_set("trait")), ",")
                                                .alias("why")))
    return _missing(expected, urls, "legal", sorted({p for _, p in RT.LEGAL_PAGES}))


# V6 --------------------------------------------------------------------------
def rule_multilingual(urls: DataFrame, site_langs: DataFrame, approach: str = RT.ML_DEFAULT) -> DataFrame:
    """V6: the localized URL of every page for every language of its site.

    ``site_langs: site_id, lang``.  Pages are the language-free paths (query
    and fragment dropped); the output per page and language is
    ``/{lang}/path`` (subdirectory), ``/path?lang=xx`` (parameter, default) or
    ``{lang}.host/path`` (subdomain).  The output is pages x languages by
    definition.  The table of languages grows with the sites, so it carries
    no broadcast hint; over the planner's threshold a large site's rows are
    split at run time (adaptive skew join).
    """
    if approach not in RT.ML_APPROACHES:
        raise ValueError(f"approach must be one of {RT.ML_APPROACHES}")
    p = with_paths(urls).withColumn("host", F.regexp_extract(clean_url(F.col("url")), HOST_PART_RE, 1))
    pages = p.groupBy("site_id", "class_path").agg(F.min("pos").alias("pos"), F.min_by("host", "pos").alias("host"))
    j = pages.join(site_langs.select("site_id", "lang").distinct(), "site_id")
    host, path, lang = F.col("host"), F.col("class_path"), F.col("lang")
    if approach == "subdirectory":
        url = F.concat(host, F.lit("/"), lang, F.when(path == "/", F.lit("/")).otherwise(path))
    elif approach == "parameter":
        url = F.concat(host, path, F.lit(f"?{RT.ML_PARAM}="), lang)
    else:
        url = F.concat(F.regexp_replace(host, "://", F.concat(F.lit("://"), lang, F.lit("."))), path)
    return j.select("site_id", "pos", "lang", F.col("class_path").alias("path"), url.alias("url"))


# V7 / V8 / V9 ----------------------------------------------------------------
def page_class(class_path: Column) -> Column:
    """The first page class whose pattern matches the path."""
    out = None
    for row in RT.PAGE_CLASSES:
        cond = class_path.rlike(row[1])
        out = F.when(cond, F.lit(row[0])) if out is None else out.when(cond, F.lit(row[0]))
    return out.otherwise(F.lit(RT.DEFAULT_CLASS[0]))


def _of_class(cls: Column, field: int) -> Column:
    """A class's value, by a literal map (``field``: 1 priority, 2 changefreq, 3 lastmod window)."""
    table = {row[0]: row[field + 1] for row in RT.PAGE_CLASSES} | {RT.DEFAULT_CLASS[0]: RT.DEFAULT_CLASS[field]}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), cls)


def expected_priority(cls: Column) -> Column:
    return _of_class(cls, 1).cast("decimal(2,1)")


def expected_changefreq(cls: Column) -> Column:
    return _of_class(cls, 2)


def lastmod_window(cls: Column) -> Column:
    return _of_class(cls, 3)


def url_hash(url: Column) -> Column:
    """First 32 bits of md5(url) as a non-negative BIGINT (md5 so the SQL twin can repeat it)."""
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("bigint")


def expected_lastmod(url: Column, cls: Column, anchor: _dt.date | str) -> Column:
    """V9: the anchor date for the homepage, else a date spread over the
    class's window (30 / 90 / 180 days) by the URL's hash."""
    a = F.to_date(F.lit(str(anchor)))
    w = lastmod_window(cls)
    return F.when(w == 0, a).otherwise(F.date_sub(a, F.pmod(url_hash(url), w).cast("int")))


def with_class(urls: DataFrame) -> DataFrame:
    """``urls`` with paths and ``page_class``; the pattern chain runs once per row (outer: see ``ingest._explode``)."""
    p = with_paths(urls)
    return p.withColumn("page_class", F.explode_outer(F.array(page_class(F.col("class_path")))))


def apply_rules(urls: DataFrame, anchor: _dt.date | str) -> DataFrame:
    """V7-V9 on every URL record: ``page_class, priority DECIMAL(2,1),
    changefreq, lastmod DATE`` (a projection; no shuffle)."""
    cls = F.col("page_class")
    return with_class(urls).select("site_id", "pos", "url", "page_class", expected_priority(cls).alias("priority"),
                                   expected_changefreq(cls).alias("changefreq"),
                                   expected_lastmod(F.col("url"), cls, anchor).alias("lastmod"))


# V10 -------------------------------------------------------------------------
def lint_violations(url: Column, max_depth: int = RT.LINT_MAX_DEPTH, max_length: int = RT.LINT_MAX_LENGTH,
                    path: Column | None = None, segs: Column | None = None) -> Column:
    """ARRAY<STRING> of URL-style violations, in a fixed order (``path``, ``segs``: of the URL, if known)."""
    path = url_path(url) if path is None else path
    segs = path_segments(url) if segs is None else segs
    checks = [
        ("uppercase", path.rlike("[A-Z]")),
        ("underscore", path.contains("_")),
        ("special_chars", ~path.rlike(r"\A[A-Za-z0-9/_\-]*+\z")),  # a search for a character outside takes ten times as long
        ("leading_digit", path.rlike("(^|/)[0-9]")),
        ("double_slash", path.contains("//")),
        ("too_deep", F.size(segs) > max_depth),
        ("too_long", F.length(url) > max_length),
        ("trailing_slash", (path != "/") & path.endswith("/")),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())


def rule_url_lint(urls: DataFrame) -> DataFrame:
    """``site_id, pos, url, violations`` for URLs with at least one."""
    return (urls.select("site_id", "pos", "url", lint_violations(F.col("url")).alias("violations"))
            .filter(F.size("violations") > 0))


def url_lint_summary(urls: DataFrame) -> DataFrame:
    """V10 per site: ``site_id, violation, n_urls`` (partial aggregation)."""
    return (rule_url_lint(urls).select("site_id", F.explode("violations").alias("violation"))
            .groupBy("site_id", "violation").agg(F.count(F.lit(1)).alias("n_urls")))


# V11 -------------------------------------------------------------------------
def sitemap_validate(records: DataFrame, approach: str = RT.ML_DEFAULT, site_industry: DataFrame | None = None,
                     site_traits: DataFrame | None = None, site_langs: DataFrame | None = None, expected_pages: DataFrame | None = None) -> DataFrame:
    """One findings table for parsed sitemap records
    (``site_id, pos, url, lastmod, changefreq, priority`` as text).

    Checks: duplicate URLs, lastmod dates not varied, invalid or
    illogical priority and changefreq, invalid lastmod, and the findings of
    V1 (exclusions), V2 (listing/detail pairs), V3 (hierarchy), pages that
    outrank their nearest ancestor, and V10 (URL style, one finding per
    violation).  Facts about the sites add: ``site_industry`` (``site_id,
    industry``) V4, ``site_traits`` (``site_id`` and flags) V5,
    ``site_langs`` (``site_id, lang``) V6 (one finding per language, with
    the pages that lack a URL in it) and ``expected_pages`` (``site_id,
    pages``) the page count.  ``records`` are read three times: pass a
    materialized table (``scratch.materialize``) when they are costly.
    """
    # the URLs are cut once here and once for the records' own findings; all rules on sets of pages read what is written
    known = records.withColumn("value", _valid_priority()).groupBy("site_id", "url").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.min("pos").alias("pos"))
    known = materialize(known.withColumn("seg_path", segment_path(url_path(F.col("url")))), "validate-urls")
    dup_f = _finding(known.filter(F.col("n") > 1), F.col("url"), "duplicate", F.concat(F.col("n").cast("string"), F.lit(" copies")))
    sites = materialize(records.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lastmod").alias("d")), "validate-sites")
    dates_f = _finding(sites.filter((F.col("n") > 1) & (F.col("d") <= 1)), F.lit(None).cast("string"), "lastmod_not_varied",
                       F.concat(F.col("n").cast("string"), F.lit(" URLs, one date")))
    paths = materialize(_nearest(known.filter(F.col("seg_path").isNotNull())), "validate-paths")
    pages = paths.select("site_id", F.col("path").alias("seg_path"))
    found = [dup_f, dates_f, _record_findings(records, approach), rule_listing_detail(pages), _hierarchy(paths, RT.MAX_LEVELS), _outranking(paths)]
    if site_industry is not None:
        found.append(rule_industry(pages, site_industry))
    if site_traits is not None:
        found.append(rule_legal(pages, site_traits))
    if site_langs is not None:
        found.append(rule_untranslated(known, site_langs, approach))
    if expected_pages is not None:
        found.append(rule_page_count(records, expected_pages, sites))
    return reduce(DataFrame.unionByName, found)


_FINDINGS = "array<struct<rule:string,detail:string>>"
#: Any path with an excluded segment, a page number or only a language code; some that match are not excluded.
_MAYBE_EXCLUDED_RE = rf"(?:^|/)(?:(?:{'|'.join(map(re.escape, RT.EXCLUDED_SEGMENTS))})(?:/|$)|page/[0-9]+$)|{RT.LANG_CODE_RE}"
#: Paths without a style violation, but for their depth and length.
_PLAIN_RE = r"\A/?(?:[a-z\-][a-z0-9\-]*+(?:/[a-z\-][a-z0-9\-]*+)*+)?\z"


def _record_findings(records: DataFrame, approach: str) -> DataFrame:
    """The findings of ``sitemap_validate`` that each record gives by itself, in one pass: fields, V1 and V10.

    Every URL is cut once.  The costly lists of V1 and V10 are made only
    for records that can have an entry in them, and a day of a month is
    parsed only if its digits don't tell.
    """
    url, path, seg_path, cls = map(F.col, ("url", "path", "seg_path", "page_class"))
    p = records.select("site_id", "url", "lastmod", "changefreq", "priority", F.col("priority").try_cast("decimal(2,1)").alias("prio"), url_path(url).alias("path"))
    p = with_class(p.withColumn("seg_path", segment_path(path)))
    prio, exp_p, exp_c = F.col("prio"), expected_priority(cls), expected_changefreq(cls)

    def finding(rule: str, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))

    plain = F.col("lastmod").rlike(r"\A[1-9][0-9]{3}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])\z")
    dated = F.when(plain, F.lit(True)).when(F.col("lastmod") == "", F.lit(False)).otherwise(F.try_to_date(F.col("lastmod"), "yyyy-MM-dd").isNotNull())
    fields = F.array(
        F.when(prio.isNull() | (prio < 0) | (prio > 1), finding("invalid_priority", F.col("priority")))
         .when(prio != exp_p, finding("priority", F.concat(F.lit("expected "), exp_p.cast("string"), F.lit(" got "), prio.cast("string")))),
        F.when(~F.col("changefreq").isin(*RT.CHANGEFREQ_VALUES), finding("invalid_changefreq", F.col("changefreq")))
         .when(F.col("changefreq") != exp_c, finding("changefreq", F.concat(F.lit("expected "), exp_c, F.lit(" got "), F.col("changefreq")))),
        F.when(~dated, finding("invalid_lastmod", F.col("lastmod"))))
    segs, none = cut_segments(seg_path), F.array().cast(_FINDINGS)
    excluded = F.when(F.contains(url, F.lit("?")) | seg_path.rlike(_MAYBE_EXCLUDED_RE),
                      F.transform(exclusion_reasons(url, segs, approach), lambda r: finding("exclude", r))).otherwise(none)
    styled = F.when(~path.rlike(_PLAIN_RE) | (F.substring_index(seg_path, "/", RT.LINT_MAX_DEPTH) != seg_path) | (F.length(url) > RT.LINT_MAX_LENGTH),
                    F.transform(lint_violations(url, path=path, segs=segs), lambda v: finding("url_style", v))).otherwise(none)
    rows = p.select("site_id", "url", F.concat(fields, excluded, styled).alias("all"))
    # outer: no filter is inferred that would make the lists again
    return rows.select("site_id", "url", F.explode_outer("all").alias("c")).filter("c is not null").select("site_id", "url", "c.rule", "c.detail")


#: Of so many sites with languages at most, the other sites' URLs are left out before they are grouped.
BROADCAST_LANGS = 100_000


def rule_untranslated(records: DataFrame, site_langs: DataFrame, approach: str = RT.ML_DEFAULT) -> DataFrame:
    """V6 as findings: per site and language the number of pages whose URL in that language is not among the records."""
    langs = materialize(site_langs.select("site_id", "lang").distinct(), "validate-langs")
    if langs.count() <= BROADCAST_LANGS:
        records = records.join(F.broadcast(langs.select("site_id").distinct()), "site_id", "left_semi")
    there = records.select("site_id", "url")
    if approach == "parameter":  # so has every URL that is looked for
        there = there.filter(F.contains("url", F.lit(f"?{RT.ML_PARAM}=")))
    missing = rule_multilingual(records, langs, approach).join(there, ["site_id", "url"], "left_anti")
    counts = missing.groupBy("site_id", "lang").agg(F.count("*").alias("n"))
    return _finding(counts, F.lit(None).cast("string"), "multilingual", F.concat(F.col("lang"), F.lit(": "), F.col("n").cast("string"), F.lit(" pages missing")))


def rule_page_count(records: DataFrame, expected_pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Sites with fewer records than ``expected_pages`` (``site_id, pages``) says (``sites``: ``site_id, n``, if counted already)."""
    got = records.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")) if sites is None else sites.select("site_id", "n")
    few = expected_pages.join(got, "site_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < F.col("pages"))
    return _finding(few, F.lit(None).cast("string"), "page_count",
                    F.concat(F.lit("expected "), F.col("pages").cast("string"), F.lit(" got "), F.col("n").cast("string")))




# V12 -------------------------------------------------------------------------
def mentioned(pairs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """``file_id, id, value``: what the phrases (one to three words -> value) that a pair says stand for; distinct.

    Of overlapping phrases the longer one counts, if it covers the shorter.
    A phrase is left out if one of the three words before it in its sentence
    negates it, or if it stands in the question and the answer's first word
    is a negation.  The phrase table is fixed and small; shingles meet it by
    broadcast, and pairs without any phrase's first word are left out first.
    """
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(phrases.items()), "phrase string, value string"))
    firsts = F.array(*[F.lit(w) for w in sorted({p.split()[0] for p in phrases})])

    def words(c: str) -> Column:
        marked = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), RT.SENTENCE_END_RE, " . ")
        return F.filter(F.split(marked, RT.PHRASE_SPLIT_RE), lambda w: w != "")

    negations = F.array(*[F.lit(w) for w in RT.NEGATIONS])
    said = settled(pairs.select("file_id", "id", words("question").alias("q"), words("answer").alias("a")))
    refused = F.array_contains(negations, F.coalesce(F.get("a", F.lit(0)), F.lit("")))
    said = said.select("file_id", "id", F.size("q").alias("n_question"), refused.alias("refused"), F.concat("q", F.array(F.lit(".")), "a").alias("w"))
    said = settled(said).filter(F.arrays_overlap("w", firsts))
    starts = said.select("file_id", "id", "n_question", "refused", "w", F.posexplode("w").alias("at", "first")).filter(F.array_contains(firsts, F.col("first")))
    near = F.slice("w", F.greatest(F.col("at") - 2, F.lit(1)), F.least(F.col("at"), F.lit(3)))
    stop = F.array_position(F.reverse(near), ".")
    before = F.when(stop > 0, F.slice(F.reverse(near), F.lit(1), stop.cast("int") - 1)).otherwise(near)
    denied = F.arrays_overlap(before, negations) | (F.col("refused") & (F.col("at") < F.col("n_question")))
    shingles = starts.select("file_id", "id", "at", denied.alias("denied"), F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("phrase")))).alias("s"))
    hits = shingles.select("file_id", "id", "at", "denied", "s.n", "s.phrase").join(table, "phrase")
    hits = hits.groupBy("file_id", "id", "at").agg(F.max(F.struct("n", "value", "denied")).alias("m")).select("file_id", "id", "at", "m.*")
    earlier = Window.partitionBy("file_id", "id").orderBy("at").rangeBetween(-2, -1)  # one pair's few phrases
    covered = F.coalesce(F.max(F.col("at") + F.col("n")).over(earlier) >= F.col("at") + F.col("n"), F.lit(False))
    return hits.withColumn("covered", covered).filter("not covered and not denied").select("file_id", "id", "value").distinct()


def profile_details(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """``file_id, explicit_pages, implied_pages, language_approach, industry`` for every row of ``profile``.

    ``explicit_pages``: pages that the pairs name and don't refuse;
    ``implied_pages``: those that the profile calls for (homepage: '');
    ``language_approach``: the approach named in most pairs (ties: the
    reference's order), the default for a multilingual profile that names
    none, null otherwise; ``industry``: the business type if it is an
    industry with pages of its own, else 'general'.
    """
    none = F.array().cast("array<string>")
    said = mentioned(pairs, RT.PAGE_PHRASES | {p: f"={a}" for p, a in RT.APPROACH_PHRASES.items()})
    pages = said.filter(~F.col("value").startswith("=")).groupBy("file_id").agg(F.sort_array(F.collect_set("value")).alias("explicit"))
    votes = said.filter(F.col("value").startswith("=")).groupBy("file_id", F.substring("value", 2, 100).alias("approach")).agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, RT.ML_APPROACHES)), F.col("approach"))
    chosen = votes.groupBy("file_id").agg(F.max_by("approach", F.struct("n", -order)).alias("named"))
    implied = planned_pages(profile).groupBy("file_id").agg(F.sort_array(F.collect_set("path")).alias("implied"))
    j = profile.join(pages, "file_id", "left").join(chosen, "file_id", "left").join(implied, "file_id", "left")
    return j.select("file_id", F.coalesce("explicit", none).alias("explicit_pages"), F.coalesce("implied", none).alias("implied_pages"),
                    F.coalesce("named", F.when(F.col("multilingual"), F.lit(RT.ML_DEFAULT))).alias("language_approach"),
                    F.when(F.col("business_type").isin(*RT.INDUSTRY_PAGES), F.col("business_type")).otherwise(F.lit("general")).alias("industry"))


def questionnaire_profile(pairs: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """Per questionnaire file ``business_type, dynamic_types,
    ecommerce, multilingual, traits, legal_pages, n_pairs``.

    Pairs are tokenised (letters and digits, lower case, distinct per
    pair), joined to the keyword table, and counted per (file, signal,
    value) with partial aggregation.  ``business_type`` is the value found
    in most pairs (ties: name order), ``'general'`` when none.
    """
    vocab = vocabulary or RT.PROFILE_KEYWORDS
    hits = (_keywords(pairs, vocab).join(_keyword_table(pairs, vocab), "token", "left").groupBy("file_id", "signal", "value")
            .agg(F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("rows")))
    per_file = hits.groupBy("file_id").agg(
        F.sum(F.when(F.col("signal").isNull(), F.col("rows"))).alias("n_pairs"),
        F.min_by(F.when(F.col("signal") == "business_type", F.col("value")),
                 F.when(F.col("signal") == "business_type", F.struct(-F.col("n"), F.col("value"))))
        .alias("bt"),
        F.sort_array(F.collect_set(F.when(F.col("signal") == "dynamic", F.col("value")))).alias("dynamic_types"),
        F.sort_array(F.collect_set(F.when(F.col("signal") == "trait", F.col("value")))).alias("traits0"))
    return _profile_columns(per_file.filter("n_pairs > 0"))


def _keyword_table(pairs: DataFrame, vocab: dict) -> DataFrame:
    return pairs.sparkSession.createDataFrame([(t, s, v) for t, (s, v) in sorted(vocab.items())], "token string, signal string, value string")


def _keywords(pairs: DataFrame, vocab: dict) -> DataFrame:
    """``file_id, id, token``: the distinct keywords of each pair, and one empty token, so that the pairs are read once."""
    text = F.lower(F.concat_ws(" ", F.col("question"), F.col("answer")))
    found = F.array_intersect(F.split(text, RT.TOKEN_SPLIT_RE), F.array(*[F.lit(t) for t in sorted(vocab)]))
    return pairs.select("file_id", "id", F.explode(F.array_union(F.array(F.lit("")), found)).alias("token"))


def _profile_columns(j: DataFrame, *more: str) -> DataFrame:
    """The columns of a profile from ``file_id, bt, dynamic_types, traits0, n_pairs``, and ``more`` as they are."""
    bt = F.coalesce(F.col("bt"), F.lit("general"))
    dyn = F.coalesce(F.col("dynamic_types"), F.array().cast("array<string>"))
    traits0 = F.coalesce(F.col("traits0"), F.array().cast("array<string>"))
    ecommerce = (bt == "ecommerce") | F.array_contains(traits0, "ecommerce")
    traits = F.array_sort(F.array_distinct(F.concat(
        traits0, F.when(ecommerce, F.array(F.lit("ecommerce"))).otherwise(F.array().cast("array<string>")))))
    legal_map = {}
    for t, page in RT.LEGAL_PAGES:
        legal_map.setdefault(t, []).append(page)
    legal = F.array_sort(F.array_distinct(F.flatten(F.transform(
        traits, lambda t: F.coalesce(F.try_element_at(F.create_map(*[x for t2, ps in sorted(legal_map.items())
                                                                    for x in (F.lit(t2), F.array(*map(F.lit, ps)))]), t),
                                     F.array().cast("array<string>"))))))
    return j.select("file_id", bt.alias("business_type"), dyn.alias("dynamic_types"),
                    ecommerce.alias("ecommerce"), F.array_contains(traits, "multilingual").alias("multilingual"),
                    traits.alias("traits"), legal.alias("legal_pages"), "n_pairs", *more)


def keyword_counts(pairs: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """``file_id, token, n``: the pairs of each file that hold a keyword; the empty token counts all its pairs.

    One partial aggregate with at most one row per file and keyword.
    """
    vocab = vocabulary or RT.PROFILE_KEYWORDS
    return _keywords(pairs, vocab).groupBy("file_id", "token").agg(F.count(F.lit(1)).alias("n"))


def evidence_weights(counts: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """``token, signal, value, n_files, n_backed, weight``: what each keyword tells, over all files.

    ``counts`` is that of :func:`keyword_counts`.  ``n_files`` files hold
    the keyword, ``n_backed`` of them another keyword of its value, too.
    The weight, in millionths, is the inverse document frequency
    ``ln((N + 1) / (n_files + 1))`` plus the log-odds of the keyword in
    files with another keyword of its value against all files (shrunk to
    all files by a prior worth one file), at least 0.  So a word of nearly
    every file weighs nothing unless it goes with its value's other words,
    and a keyword without others has its document frequency alone.  Every
    keyword has a row, also one that no file holds.
    """
    vocab = vocabulary or RT.PROFILE_KEYWORDS
    table = _keyword_table(counts, vocab)
    total = F.lit(counts.filter("token = ''").count())
    by_value = counts.join(F.broadcast(table), "token").groupBy("file_id", "signal", "value").agg(F.collect_list("token").alias("tokens"))
    held = by_value.select("value", "signal", F.size("tokens").alias("k"), F.posexplode("tokens").alias("at", "token"))
    held = held.groupBy("token").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("k") > 1).alias("n_backed"), F.count_if(F.col("at") == 0).alias("firsts"))
    held = table.join(held, "token", "left").na.fill(0, ["n_files", "n_backed", "firsts"])
    # a few dozen rows; a file is counted once per value, at the first of its tokens
    of_value = F.sum("firsts").over(Window.partitionBy("signal", "value"))
    others = of_value - F.col("n_files") + F.col("n_backed")
    share = (F.col("n_files") + 0.5) / (total + 1)
    odds = F.log((F.col("n_backed") + share) / (others - F.col("n_backed") + 1 - share)) - F.log(share / (1 - share))
    weight = F.greatest(F.lit(0.0), F.log((total + 1) / (F.col("n_files") + 1)) + odds)
    return held.select("token", "signal", "value", "n_files", "n_backed", F.round(weight * 1_000_000).cast("long").alias("weight"))


def weighted_profile(counts: DataFrame, weights: DataFrame, least: int = 693_147) -> DataFrame:
    """:func:`questionnaire_profile` by evidence instead of numbers of pairs; ``evidence`` is added.

    ``weights``: a table as of :func:`evidence_weights`, in millionths.  A
    value's evidence is the sum of its keywords' weights over the pairs
    that hold them.  ``business_type`` has the most (ties: name order),
    ``'general'`` if that is under ``least`` (ln 2); dynamic types and
    traits hold with at least ``least``.  ``evidence`` is that of the
    business type, 0 for ``'general'``.
    """
    hits = counts.join(F.broadcast(weights.select("token", "signal", "value", "weight")), "token", "left").groupBy("file_id", "signal", "value").agg(
        F.sum(F.col("n") * F.col("weight")).alias("e"), F.sum("n").alias("n"))
    holds = F.col("e") >= least
    kind = holds & (F.col("signal") == "business_type")
    per_file = hits.groupBy("file_id").agg(
        F.sum(F.when(F.col("signal").isNull(), F.col("n"))).alias("n_pairs"),
        F.min_by(F.when(kind, F.col("value")), F.when(kind, F.struct(-F.col("e"), F.col("value")))).alias("bt"),
        F.coalesce(F.max(F.when(kind, F.col("e"))), F.lit(0)).alias("evidence"),
        F.sort_array(F.collect_set(F.when(holds & (F.col("signal") == "dynamic"), F.col("value")))).alias("dynamic_types"),
        F.sort_array(F.collect_set(F.when(holds & (F.col("signal") == "trait"), F.col("value")))).alias("traits0"))
    return _profile_columns(per_file.filter("n_pairs > 0"), "evidence")


def planned_pages(profile: DataFrame) -> DataFrame:
    """The page set a profile implies (the default generator's sitemap):
    homepage, base pages, listing + detail page per dynamic type, the
    industry's pages and the legal pages; ``file_id, path`` distinct."""
    ld = dict(RT.LISTING_DETAIL)
    ind = F.create_map(*[x for k, ps in sorted(RT.INDUSTRY_PAGES.items()) for x in (F.lit(k), F.array(*map(F.lit, ps)))])
    dyn_pages = F.flatten(F.transform("dynamic_types", lambda d: F.array(
        d, F.concat(d, F.lit("/"), F.try_element_at(_lit_map(ld), d)))))
    pages = F.concat(F.array(F.lit(""), *[F.lit(p) for p in RT.BASE_PAGES]), dyn_pages,
                     F.coalesce(F.try_element_at(ind, F.col("business_type")), F.array().cast("array<string>")),
                     F.col("legal_pages"))
    return profile.select("file_id", F.explode(F.array_distinct(pages)).alias("path"))


def estimated_pages(profile: DataFrame) -> DataFrame:
    """``file_id, estimated_pages``: the number of pages that the profile implies."""
    return planned_pages(profile).groupBy("file_id").agg(F.count(F.lit(1)).alias("estimated_pages"))


def profile_findings(records: DataFrame, profile: DataFrame) -> DataFrame:
    """V11 from V12 facts: industry and legal pages that a site lacks, and fewer pages than its profile implies.

    ``records``: ``site_id, pos, url``; a site is the questionnaire file of ``profile``.
    """
    industry = profile.select(F.col("file_id").alias("site_id"), F.col("business_type").alias("industry"))
    legal = profile.select(F.col("file_id").alias("site_id"), F.explode("legal_pages").alias("path"), F.lit("profile").alias("why"))
    pages = estimated_pages(profile).select(F.col("file_id").alias("site_id"), F.col("estimated_pages").alias("pages"))
    count = rule_page_count(records, pages)
    return rule_industry(records, industry).unionByName(_missing(legal, records, "legal")).unionByName(count)

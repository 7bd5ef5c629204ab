"""Sitemap XML: write (S4), parse (P1-P3), pull XML out of model replies (M4).

Parsing follows the reference's effective path: a structured reading that
only accepts the sitemap namespace, and for malformed text a regex scan for
``<loc>...</loc>``.  The corrupt-record column of Spark's ``from_xml`` and
the fold over the tags (``xmlfold``) decide the branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.settle import settled
from ..functions.text import PY_WS, py_strip
from .xmlfold import document_entries, tags_and_text, without_doctype

# --- fixed values -----------------------------------------------------------
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
XML_DECL = '<?xml version="1.0" encoding="UTF-8"?>'
MAX_URLS_PER_SITEMAP = 50_000          # sitemap protocol limit per document
# fallback scan: no entity decoding; a line ends at "\n" only, as in the reference ((?d) for Java)
LOC_RE = r"(?d)<loc>(.*?)</loc>"
FENCE_RE = r"(?is)```xml" + PY_WS + r"*(.*?)```"
DECL_RE = r"(?is)<\?xml.*?</urlset>"
URLSET_RE = r"(?is)<urlset.*?</urlset>"
OPEN_FENCE_RE = r"(?i)```xml" + PY_WS + "*"
CLOSE_FENCE_RE = r"(?i)```" + PY_WS + r"*\z"
# ---------------------------------------------------------------------------

URL_FIELDS = ("loc", "lastmod", "changefreq", "priority")


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str) -> Column:
    v = F.coalesce(F.col(name if name != "loc" else "url"), F.lit(""))
    body = F.concat(F.lit(f"    <{name}>"), xml_escape(v), F.lit(f"</{name}>\n"))
    if name == "loc":
        return body
    return F.when(v != "", body).otherwise(F.lit(""))


#: What comes before the entries.
SITEMAP_HEAD = XML_DECL + "\n" + f'<urlset xmlns="{SITEMAP_NS}">'


def sitemap_entry() -> Column:
    """The ``<url>`` element of a URL record."""
    return F.concat(F.lit("  <url>\n"), *[_element(n) for n in URL_FIELDS], F.lit("  </url>\n"))


def sitemap_write(urls: DataFrame, max_urls: int | None = None) -> DataFrame:
    """``site_id, chunk, n_urls, xml``: one ``<urlset>`` per site, in
    ``pos`` order (dense or sparse).  ``max_urls``: a document ends after so
    many URLs (the protocol allows 50,000) and the next chunk begins.
    Empty optional fields are left out.  A document is one value: for sites
    beyond that see ``sinks.write_sitemap_files``."""
    rows = urls.select("site_id", "pos", sitemap_entry().alias("entry"))
    if max_urls is None:
        rows = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    else:
        rows = ranked(rows, ["site_id"], ["pos", "entry"], "place").withColumn("chunk", F.floor(F.col("place") / max_urls))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))),
                                    lambda s: s["entry"]), "")
    return (rows.groupBy("site_id", "chunk")
            .agg(F.count(F.lit(1)).alias("n_urls"),
                 F.concat(F.lit(SITEMAP_HEAD + "\n"), body,
                          F.lit("</urlset>\n")).alias("xml")))


def clean(c: Column) -> Column:
    return F.coalesce(py_strip(c), F.lit(""))


# --- P1-P3 --------------------------------------------------------------------
_RECORD = "array<struct<pos:bigint,url:string,lastmod:string,changefreq:string,priority:string,method:string>>"


def _entries(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(
        e["pos"].alias("pos"), e["loc"].alias("url"), *(clean(e[f]).alias(f) for f in URL_FIELDS[1:]), F.lit("xml").alias("method"))).cast(_RECORD)


def parsed_entries(docs: DataFrame, require_namespace: bool = True) -> DataFrame:
    """``docs`` (with ``xml``) and ``entries``: the entries of a well-formed document, null for a malformed one.

    ``from_xml`` judges the tags and the characters inside the root element;
    the fold judges namespaces, entities and what stands outside the root.
    Documents over the XML reader's own limits (elements nested over 1,000
    deep, over 1,000 attributes in a tag) count as malformed.
    """
    plain = settled(docs.withColumn("plain", without_doctype(F.col("xml"))))
    parsed = F.from_xml(F.col("plain"), "none STRING, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    formed = settled(plain.withColumn("plain", F.when(parsed["_corrupt"].isNull(), tags_and_text(F.col("plain")))))
    return document_entries(formed, SITEMAP_NS if require_namespace else None)


def sitemap_parse(docs: DataFrame, keys: tuple[str, ...] = ("site_id",), require_namespace: bool = True) -> DataFrame:
    """URL records ``keys, pos, url, lastmod, changefreq, priority, method``.

    Well-formed text: one record per ``<url>`` element of the sitemap
    namespace, at any depth, that has a ``<loc>`` child in it (its first);
    a namespace that is declared but not in scope gives none.
    ``require_namespace=False`` takes ``<url>`` of any namespace or none,
    and its children in the same one.
    Malformed text: every ``<loc>(.*?)</loc>``, entities left as they are,
    other fields empty.  ``pos`` is the element's place among the document's
    ``<url>`` elements (also those without ``<loc>``) or matches.  A null
    document gives no record.  Each document is read once.
    """
    locs = F.transform(F.regexp_extract_all(F.col("xml"), F.lit(LOC_RE), 1), lambda u, i: F.struct(
        i.cast("bigint").alias("pos"), u.alias("url"), F.lit("").alias("lastmod"), F.lit("").alias("changefreq"), F.lit("").alias("priority"),
        F.lit("regex").alias("method")))
    parsed = parsed_entries(docs.select(*keys, "xml"), require_namespace)
    found = F.when(F.col("entries").isNull(), locs.cast(_RECORD)).otherwise(_entries(F.col("entries")))
    return (parsed.select(*keys, F.explode_outer(found).alias("u")).filter(F.col("u.url").isNotNull())
            .select(*keys, "u.pos", clean(F.col("u.url")).alias("url"), "u.lastmod", "u.changefreq", "u.priority", "u.method"))


def sitewide_pos(records: DataFrame) -> DataFrame:
    """Records of chunked documents (``site_id, chunk, pos``) with ``pos`` unique per site: chunks follow each other."""
    sizes = records.groupBy("site_id", "chunk").agg((F.max("pos") + 1).alias("n"))
    before = Window.partitionBy("site_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("site_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return records.join(starts, ["site_id", "chunk"]).withColumn("pos", F.col("pos") + F.col("start")).drop("start")


# --- M4 ---------------------------------------------------------------------

def _strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, OPEN_FENCE_RE, ""), CLOSE_FENCE_RE, "")


def _with_decl(c: Column) -> Column:
    return F.when(c.startswith(F.lit("<?xml")), c).otherwise(F.concat(F.lit(XML_DECL + "\n"), c))


def extract_xml(text: Column) -> Column:
    """M4: the sitemap XML inside a model reply.

    A fenced ```xml block (declaration added when missing), else the span
    from ``<?xml`` to ``</urlset>``, else the ``<urlset>`` element
    (declaration added), else the text itself.
    """
    fenced = py_strip(F.regexp_extract(text, FENCE_RE, 1))
    decl = py_strip(_strip_fences(py_strip(F.regexp_extract(text, DECL_RE, 0))))
    urlset = _strip_fences(py_strip(F.regexp_extract(text, URLSET_RE, 0)))
    return (F.when(text.rlike(FENCE_RE), _with_decl(fenced))
            .when(text.rlike(DECL_RE), decl)
            .when(text.rlike(URLSET_RE), _with_decl(urlset))
            .otherwise(text))


def extract_branch(text: Column) -> Column:
    return (F.when(text.rlike(FENCE_RE), F.lit("fenced"))
            .when(text.rlike(DECL_RE), F.lit("declaration"))
            .when(text.rlike(URLSET_RE), F.lit("urlset"))
            .otherwise(F.lit("raw")))

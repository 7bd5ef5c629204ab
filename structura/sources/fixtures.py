"""Inputs derived in-query from the driver tables.

The reference ships no data; these DataFrames turn the driver's parquet
tables into the shapes the operators consume (URL tables, questionnaire
files, sitemap documents, model replies).  All of them grow with the
tables and each has a DuckDB twin in :mod:`structura.plans.sqlparts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.url import url_host
from .tables import table

CATALOG_HOST = "https://shop.example.com/"
# Ordinal stride per order: more than the most line items one order has.
ORDER_STRIDE = 64


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL records from ``pages``: one site per host, document order = page_id."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select(url_host(F.col("url")).alias("site_id"),
                    F.col("page_id").alias("pos"), "url",
                    F.lit("").alias("lastmod"), F.lit("").alias("changefreq"),
                    F.lit("").alias("priority"))


def catalog_urls(spark: SparkSession, sf_dir: str, shorten: bool = False) -> DataFrame:
    """Deep URLs from lineitem x supplier x nation x region x part.

    ``pos`` is a sparse, unique ordinal in (orderkey, linenumber, partkey,
    suppkey) order: the order key times a stride plus the rank inside the
    order (a window over one order's lines only, never over a whole site).
    With ``shorten`` the path keeps ``8 - l_orderkey % 9`` segments, which
    yields homepages, main pages and every depth.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    sup = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    # nation and region have 25 and 5 rows by definition: safe to broadcast.
    nat = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"))
    reg = F.broadcast(table(spark, sf_dir, "region", "r_regionkey", "r_name"))
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    # supplier and part grow with the scale factor: no hint, the planner
    # broadcasts them only under spark.sql.autoBroadcastJoinThreshold.
    geo = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
           .join(reg, nat.n_regionkey == reg.r_regionkey)
           .select("s_suppkey", slug(F.col("n_name")).alias("n_slug"), slug(F.col("r_name")).alias("r_slug")))
    part = part.select("p_partkey", slug(F.col("p_brand")).alias("b_slug"), slug(F.col("p_type")).alias("t_slug"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    j = (li.join(geo, li.l_suppkey == geo.s_suppkey)
         .join(part, li.l_partkey == part.p_partkey)
         .withColumn("rk", F.row_number().over(w) - 1))
    segs = F.array(
        F.col("n_slug"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
        F.col("b_slug"),
        F.col("t_slug"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")),
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")),
        F.lit("detail"),
    )
    if shorten:
        segs = F.slice(segs, F.lit(1), F.lit(8) - (F.col("l_orderkey") % 9).cast("int"))
    return j.select(
        F.col("r_slug").alias("site_id"),
        (F.col("l_orderkey") * ORDER_STRIDE + F.col("rk")).alias("pos"),
        F.concat(F.lit(CATALOG_HOST), F.array_join(segs, "/")).alias("url"),
        F.lit("").alias("lastmod"), F.lit("").alias("changefreq"), F.lit("").alias("priority"),
    )


# --- sitemap documents and model replies ------------------------------------
# Variant of a site's document, chosen by variant_of(site_id, 10):
#   0 plain, 1 prefixed namespace, 2 no namespace, 3 another namespace,
#   4 bare '&', 5 truncated, 6 blank before '<?xml', 7 '<loc/>',
#   8 first entry without loc, 9 comments and image extension.
OTHER_NS = "http://example.com/schemas/other/1.0"
IMAGE_NS = "http://www.google.com/schemas/sitemap-image/1.1"
IMAGE_ENTRY = ("    <!-- image -->\n    <image:image><image:loc>https://img.example.com/a.png"
               "</image:loc></image:image>\n  </url>")


def variant_of(c, n: int):
    """A well-spread deterministic variant number in [0, n) (md5 based, so
    the DuckDB twin computes the same)."""
    h = F.md5(c)
    return (F.ascii(F.substring(h, 1, 1)) * 7 + F.ascii(F.substring(h, 2, 1))) % n


def _first_loc_replaced(x, repl: str):
    i = F.instr(x, "<loc>")
    j = F.instr(x, "</loc>\n")
    return F.concat(F.substring(x, F.lit(1), i - 1), F.lit(repl), F.substring(x, j + 7, F.lit(1 << 30)))


def sitemap_docs(spark: SparkSession, sf_dir: str, variants: bool = True) -> DataFrame:
    """One ``<urlset>`` per host of ``pages``, in variants."""
    from ..operators.sitemap import SITEMAP_NS, sitemap_write
    docs = sitemap_write(page_urls(spark, sf_dir))
    if not variants:
        return docs.withColumn("variant", F.lit(0))
    x = F.col("xml")
    v = variant_of(F.col("site_id"), 10)
    root = f'<urlset xmlns="{SITEMAP_NS}">'
    out = (F.when(v == 1, F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(
                x, F.lit(root), F.lit(f'<sm:urlset xmlns:sm="{SITEMAP_NS}">')),
                F.lit("</urlset>"), F.lit("</sm:urlset>")), F.lit("<url>"), F.lit("<sm:url>")),
                F.lit("</url>"), F.lit("</sm:url>")), F.lit("<loc>"), F.lit("<sm:loc>")),
                F.lit("</loc>"), F.lit("</sm:loc>")), F.lit("<lastmod>"), F.lit("<sm:lastmod>")))
           .when(v == 2, F.replace(x, F.lit(f' xmlns="{SITEMAP_NS}"'), F.lit("")))
           .when(v == 3, F.replace(x, F.lit(SITEMAP_NS), F.lit(OTHER_NS)))
           .when(v == 4, F.replace(x, F.lit("</urlset>"), F.lit("<note>R&D</note>\n</urlset>")))
           .when(v == 5, F.substring(x, F.lit(1), (F.length(x) * 2 / 3).cast("int")))
           .when(v == 6, F.concat(F.lit(" "), x))
           .when(v == 7, _first_loc_replaced(x, "<loc/>\n"))
           .when(v == 8, _first_loc_replaced(x, ""))
           .when(v == 9, F.replace(F.replace(x, F.lit(root), F.lit(
                f'<urlset xmlns="{SITEMAP_NS}" xmlns:image="{IMAGE_NS}">')),
                F.lit("  </url>"), F.lit(IMAGE_ENTRY)))
           .otherwise(x))
    return docs.select("site_id", "chunk", v.alias("variant"), out.alias("xml"))


# Reply shape, chosen by variant_of(site_id, 5): 0 fenced ```xml block,
# 1 fenced without declaration, 2 bare with prose around, 3 <urlset> only
# with prose, 4 no XML at all.
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sitemap import XML_DECL
    docs = sitemap_docs(spark, sf_dir, variants=False)
    x = F.col("xml")
    body = F.substring(x, F.lit(len(XML_DECL) + 2), F.lit(1 << 30))
    v = variant_of(F.col("site_id"), 5)
    sid = F.col("site_id")
    resp = (F.when(v == 0, F.concat(F.lit("ANALYSIS:\nBusiness Type: shop\n\n```xml\n"), x,
                                    F.lit("```\n\nNOTES: none")))
            .when(v == 1, F.concat(F.lit("```XML\n"), body, F.lit("```")))
            .when(v == 2, F.concat(F.lit("Here is the sitemap for "), sid, F.lit(":\n"), x,
                                   F.lit("\nNOTES: generated.")))
            .when(v == 3, F.concat(F.lit("Sitemap below.\n"), body, F.lit("\nThanks.")))
            .otherwise(F.concat(F.lit("I could not build a sitemap for "), sid, F.lit("."))))
    return docs.select(F.concat(sid, F.lit("#"), F.col("chunk").cast("string")).alias("file_id"),
                       resp.alias("response"), F.lit(None).cast("string").alias("error"))


# --- questionnaire files -----------------------------------------------------
QFILE_CONVS = 20          # conversations per questionnaire file
QFILE_HEADER = "Section,Question,Answer"
LATIN1_RE = r"\A[\x{0}-\x{FF}]*\z"


def qa_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer rows straight from ``conversations``: a user turn
    followed by an assistant turn (window over one conversation only)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (c.select("conv_id", "turn", "role", F.col("text").alias("question"),
                     F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
            .filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .withColumn("file_no", F.floor(F.col("conv_id") / QFILE_CONVS))
            .select(F.concat(F.lit("qfile-"), F.col("file_no").cast("string")).alias("file_id"),
                    "file_no", "conv_id", "turn", "question", "answer"))


def _csv_quote(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def qfiles_text(spark: SparkSession, sf_dir: str, delim: str = ",") -> DataFrame:
    """One CSV text per questionnaire file (``file_id, variant, text``).

    A preamble line and a blank line precede the header; records are quoted
    with doubled quotes.  Variant (file number % 4): 0 plain, 1 CRLF
    record ends (newlines inside cells stay LF), 2 ISO-8859-1 bytes, 3 an
    extra 'Client Name' column filled on the first row only.  ``delim``
    separates the fields (the semicolon files test dialect sniffing).
    """
    src = qa_source(spark, sf_dir)
    v = (F.col("file_no") % 4).cast("int")
    w = Window.partitionBy("file_id").orderBy("conv_id", "turn")
    first = F.row_number().over(w) == 1
    fields = [F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")),
              F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))]
    rec = F.concat_ws(delim, *[_csv_quote(f) for f in fields])
    client = F.when(first, F.concat(F.lit(delim + '"Acme Corp '), F.col("file_id"), F.lit('"'))).otherwise(F.lit(""))
    rec = F.when(v == 3, F.concat(rec, client)).otherwise(rec)
    eol = F.when(v == 1, F.lit("\r\n")).otherwise(F.lit("\n"))
    recs = src.select("file_id", "conv_id", "turn", v.alias("variant"), F.concat(rec, eol).alias("rec"))
    hdr = QFILE_HEADER.replace(",", delim)
    header = F.when(F.col("variant") == 3, F.lit(hdr + delim + "Client Name")).otherwise(F.lit(hdr))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "rec"))),
                                    lambda s: s["rec"]), "")
    files = recs.groupBy("file_id", "variant").agg(body.alias("body"))
    feol = F.when(F.col("variant") == 1, F.lit("\r\n")).otherwise(F.lit("\n"))
    return files.select(
        "file_id", "variant",
        F.concat(F.lit(f"Client Name{delim}Acme "), F.col("file_id"), feol, feol, header, feol,
                 F.col("body")).alias("text"))


def qfiles(spark: SparkSession, sf_dir: str, delim: str = ",") -> DataFrame:
    """``file_id, content BINARY``: the texts above as bytes."""
    t = qfiles_text(spark, sf_dir, delim)
    latin = (F.col("variant") == 2) & F.col("text").rlike(LATIN1_RE)
    return t.select("file_id", F.when(latin, F.encode("text", "ISO-8859-1"))
                    .otherwise(F.encode("text", "UTF-8")).alias("content"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text read as if it were an uploaded CSV file:
    irregular prose with commas, quotes and blank lines exercises the header
    search, record assembly and rejects."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"),
                    F.encode("text", "UTF-8").alias("content"))


# --- shop URLs: listing pages, subcategories, templates, legal pages -----------
SHOP_LEGAL = ["privacy-policy", "terms-and-conditions", "cookie-policy", "contact"]


def shop_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-structure URLs from lineitem x part: one site per brand; the
    listing comes from the part key, the page kind from the line number
    (listing, subcategory, item, detail template for every other listing
    kind or about, homepage, legal
    or contact, tag archive).  ``pos``: order key times a stride plus the
    rank inside the order, which is unique (line numbers are not)."""
    from ..operators.rule_tables import LISTING_DETAIL
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("rk", F.row_number().over(w) - 1)
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    part = part.select("p_partkey", slug(F.col("p_brand")).alias("site"), slug(F.col("p_type")).alias("ptype"))
    j = li.join(part, li.l_partkey == part.p_partkey)
    k = len(LISTING_DETAIL)
    listing = F.get(F.array(*[F.lit(a) for a, _ in LISTING_DETAIL]), (F.col("l_partkey") % k).cast("int"))
    detail = F.get(F.array(*[F.lit(b) for _, b in LISTING_DETAIL]), (F.col("l_partkey") % k).cast("int"))
    legal = F.get(F.array(*map(F.lit, SHOP_LEGAL)), (F.col("l_orderkey") % len(SHOP_LEGAL)).cast("int"))
    ptype = F.col("ptype")
    ln = F.col("l_linenumber")
    path = (F.when(ln == 1, F.concat(F.lit("/"), listing))
            .when(ln == 2, F.concat(F.lit("/"), listing, F.lit("/"), ptype))
            .when(ln == 3, F.concat(F.lit("/"), listing, F.lit("/"), ptype, F.lit("/p"),
                                    F.col("l_partkey").cast("string")))
            .when(ln == 4, F.when((F.col("l_partkey") % k) % 2 == 0, F.concat(F.lit("/"), listing, F.lit("/"), detail))
                  .otherwise(F.lit("/about")))
            .when(ln == 5, F.lit("/"))
            .when(ln == 6, F.concat(F.lit("/"), legal))
            .otherwise(F.concat(F.lit("/tag/"), ptype)))
    site = F.col("site")
    return j.select(site.alias("site_id"), (F.col("l_orderkey") * ORDER_STRIDE + F.col("rk")).alias("pos"),
                    F.concat(F.lit("https://"), site, F.lit(".example.com"), path).alias("url"),
                    F.lit("").alias("lastmod"), F.lit("").alias("changefreq"), F.lit("").alias("priority"))

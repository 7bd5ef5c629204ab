"""Sitemap entries by a left-to-right fold over a document's tags.

Comments and processing instructions are taken out first and CDATA sections
become escaped text, so what is left are tags and text.  ``aggregate`` walks
over them once with a small state: the depth, the namespace bindings in
scope, the open ``url`` elements with what is known of their fields, and the
field whose text is being read.  No pattern ever sees nesting, so names are
matched by namespace and not by prefix, fields are direct children only, and
documents of any depth need no recursion.  Everything is a column
expression.

A document is cut behind every end tag of a ``url``.  Where each piece is
one whole entry below the root, pieces are read one by one: by plain
patterns if the entry is flat (fields without attributes or children), by
the fold inside the root's tag if not.  Any other document is folded as a
whole.  Both ways give the same entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settle import let, settled

FIELDS = ("loc", "lastmod", "changefreq", "priority")
TEXT, START, EMPTY, END, BAD = range(5)
#: Finished entries are gathered in blocks, so that appending one never copies them all.
BLOCK = 256

_Q = r""""[^"]*+"|'[^']*+'"""
_DOCTYPE_RE = rf"""<!DOCTYPE(?:[^\["'>]|{_Q})*+(?:\[(?:<!--.*?-->|[^\]"'<]|<(?!!--)|{_Q})*+\]\s*+)?+>"""
_ENTITY_RE = rf"""<!ENTITY\s++([^\s%"']++)\s++({_Q})\s*+>"""
_MARKUP_RE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|[^<]++|<"
_TAG_RE = rf"""<(?![!?])[^>"']*+(?:(?:{_Q})[^>"']*+)*+>"""
ROOT_RE = rf"\A\s*+({_TAG_RE})"
_TOKEN_RE = rf"{_TAG_RE}|[^<]++|<"
_ATTRIBUTE_RE = rf"""\s([^\s=/>"']++)\s*+=\s*+({_Q})"""
_UNKNOWN_RE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"
_PIECE_RE = r"[^<]*+(?:<(?!/(?:[^\s<>:/]++:)?url\s*+>)[^<]*+)*+(?:</(?:[^\s<>:/]++:)?url\s*+>|\z)"
URL_RE = r"<(?:[^\s<>:/]++:)?url(?=[\s/>])"
_FIRST_RE = r"\A[^<]*+<(?:[^\s<>:/]++:)?url(?=[\s>])"
_FLAT_RE = (r"\A\s*+<((?:[A-Za-z_][A-Za-z0-9_.\-]*+:)?+)url\s*+>(?:\s*+<\1([A-Za-z_][A-Za-z0-9_.\-]*+)>[^<]*+</\1\2\s*+>)*+"
            r"\s*+</\1url\s*+>\z")
_LAST_RE = r"\A\s*+</[^<>]++>\s*+\z"

_TOKENS = "array<struct<kind:int,prefix:string,local:string,bound:array<struct<p:string,u:string>>,used:array<string>,text:string>>"
_OPEN = "struct<d:int,pos:bigint,ns:string," + ",".join(f"{f}:string" for f in FIELDS) + ">"
_ENTRY = "struct<pos:bigint," + ",".join(f"{f}:string" for f in FIELDS) + ">"
_FOUND = f"struct<n:bigint,entries:array<{_ENTRY}>>"
_STATE = (f"struct<depth:int,scopes:array<struct<d:int,p:string,u:string>>,open:array<{_OPEN}>,pos:bigint,field:string,text:string,roots:int,bad:boolean,"
          f"recent:array<{_ENTRY}>,blocks:array<array<{_ENTRY}>>>")


def numeric_references(c: Column) -> Column:
    """``&#38;`` and ``&#x26;`` as characters."""
    def char(part: Column) -> Column:
        digits = F.regexp_extract(part, r"\A(x?[0-9A-Fa-f]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 7), 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("bigint")
        one = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when((digits != "") & code.between(1, 0x10FFFF), F.concat(one, F.substring(part, F.length(digits) + 2, F.lit(1 << 30))))
                .otherwise(F.concat(F.lit("&#"), part)))

    parts = F.split(c, "&#")
    return F.when(c.contains("&#"), F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), char), ""))).otherwise(c)


def decoded(c: Column) -> Column:
    """Text with the predefined entities and numeric references as characters."""
    plain = c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), F.replace(numeric_references(plain), F.lit("&amp;"), F.lit("&"))).otherwise(c)


def without_doctype(xml: Column) -> Column:
    """The document with its DOCTYPE taken out and the entities that it declares put in (text only; the first declaration holds)."""
    doctype = F.regexp_extract(xml, "(?s)" + _DOCTYPE_RE, 0)
    declared = F.regexp_extract_all(doctype, F.lit("(?s)" + _ENTITY_RE), F.lit(0))
    body = F.replace(xml, doctype, F.lit(""))

    def put(text: Column, one: Column) -> Column:
        name = F.regexp_extract(one, "(?s)" + _ENTITY_RE, 1)
        value = F.regexp_extract(one, "(?s)" + _ENTITY_RE, 2)
        return F.replace(text, F.concat(F.lit("&"), name, F.lit(";")), F.substring(value, F.lit(2), F.length(value) - 2))

    return F.when(xml.contains("<!DOCTYPE") & (doctype != ""), F.aggregate(declared, body, put)).otherwise(xml)


def tags_and_text(xml: Column) -> Column:
    """The document without comments and processing instructions, CDATA sections as escaped text; a declaration that doesn't come first stays."""
    def escaped(c: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    parts = F.transform(F.regexp_extract_all(xml, F.lit(_MARKUP_RE), F.lit(0)), lambda t, i: (
        F.when(t.startswith("<!--") & t.endswith("-->"), F.lit(""))
        .when(t.startswith("<![CDATA[") & t.endswith("]]>"), escaped(F.substring(t, F.lit(10), F.length(t) - 12)))
        .when(t.startswith("<?") & t.endswith("?>") & ((i == 0) | ~t.rlike(r"\A<\?[xX][mM][lL][\s?]")), F.lit("")).otherwise(t)))
    # a section behind the root element is no text of it, not even an empty one
    behind = F.substring_index(xml, "</", -1).contains("<![CDATA[")
    return F.when(xml.contains("<!") | xml.contains("<?"), F.concat(F.array_join(parts, ""), F.when(behind, F.lit("<")).otherwise(F.lit("")))).otherwise(xml)


def _bound(attributes: Column) -> Column:
    """The namespace bindings among attributes (``name="value"``), as ``array<struct<p,u>>``."""
    def one(a: Column) -> Column:
        name, value = F.regexp_extract(a, _ATTRIBUTE_RE, 1), F.regexp_extract(a, _ATTRIBUTE_RE, 2)
        return F.struct(F.regexp_replace(name, r"\Axmlns:?", "").alias("p"), decoded(F.substring(value, F.lit(2), F.length(value) - 2)).alias("u"))
    return F.transform(F.filter(attributes, lambda a: a.rlike(r"\A\sxmlns[:=\s]")), one)


def _attributes(tag: Column) -> Column:
    return F.regexp_extract_all(tag, F.lit(_ATTRIBUTE_RE), F.lit(0))


def _token(t: Column) -> Column:
    def made(kind: Column, name: Column, text: Column, bound: Column | None = None, used: Column | None = None) -> Column:
        nothing = F.lit(None)
        return F.struct(kind.cast("int").alias("kind"), F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise(F.lit("")).alias("prefix"),
                        F.regexp_replace(name, r"\A[^:]*+:", "").alias("local"), (nothing if bound is None else bound).alias("bound"),
                        (nothing if used is None else used).alias("used"), text.alias("text"))

    kind = F.when(t.startswith("</"), END).when(t.endswith("/>"), EMPTY).otherwise(START)
    used = F.filter(F.transform(_attributes(t), lambda a: F.regexp_extract(a, r"\A\s([^\s=:]++):", 1)), lambda p: ~p.isin("", "xml", "xmlns"))
    name, blank = F.regexp_extract(t, r"\A</?+([^\s/>]*+)", 1), F.lit("")
    return (F.when(t.contains("&") & t.rlike(_UNKNOWN_RE) | t.startswith("<!") | t.startswith("<?") | (t == "<"), made(F.lit(BAD), blank, blank))
            .when(~t.startswith("<"), made(F.lit(TEXT), blank, decoded(t)))
            .otherwise(made(kind, name, blank, F.when(t.contains("xmlns"), _bound(_attributes(t))), F.when(t.contains(":") & t.contains("="), used))))


def tokens(text: Column) -> Column:
    """Tags and texts, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN_RE), F.lit(0)), _token).cast(_TOKENS)


def _with(state: Column, **changes: Column) -> Column:
    names = ("depth", "scopes", "open", "pos", "field", "text", "roots", "bad", "recent", "blocks")
    return F.struct(*((changes[n] if n in changes else state[n]).alias(n) for n in names)).cast(_STATE)


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a))


def _set(entry: Column, **changes: Column) -> Column:
    return F.struct(*((changes[n] if n in changes else entry[n]).alias(n) for n in ("d", "pos", "ns", *FIELDS)))


def _settle(s: Column) -> Column:
    """The text of the field that was being read goes to its entry, the innermost open one."""
    top = F.get(s["open"], F.lit(0))
    filled = _set(top, **{f: F.when(s["field"] == f, s["text"]).otherwise(top[f]) for f in FIELDS})
    return F.when(s["field"] == "", s).otherwise(_with(s, open=F.concat(F.array(filled), _rest(s["open"])), field=F.lit(""), text=F.lit("")))


def _opened(s: Column, t: Column, namespace: str | None) -> Column:
    """A start tag, or the start of an empty element."""
    depth = s["depth"] + 1
    scopes = F.when(F.size(F.coalesce(t["bound"], F.array())) > 0, F.concat(
        F.transform(t["bound"], lambda b: F.struct(depth.alias("d"), b["p"].alias("p"), b["u"].alias("u"))), s["scopes"])).otherwise(s["scopes"])

    def within(w: Column) -> Column:
        scopes, ns = w["scopes"], w["ns"]
        strange = F.exists(t["used"], lambda p: ~F.exists(scopes, lambda x: (x["p"] == p) & (x["u"] != "")))
        top = F.get(s["open"], F.lit(0))
        entry = (t["local"] == "url") & ((ns == namespace) & (s["depth"] > 0) if namespace is not None else F.lit(True))
        taken = F.coalesce(*[F.when(t["local"] == f, top[f].isNotNull()) for f in FIELDS], F.lit(True))
        field = F.coalesce((top["d"] == s["depth"]) & (ns == top["ns"]) & ~taken & ~entry, F.lit(False))
        fresh = F.struct(depth.alias("d"), s["pos"].alias("pos"), ns.alias("ns"), *(F.lit(None).cast("string").alias(f) for f in FIELDS)).cast(_OPEN)
        bad = s["bad"] | F.coalesce(strange, F.lit(False)) | ((t["prefix"] != "") & (ns == "")) | ((s["depth"] == 0) & (s["roots"] > 0))
        return _with(s, depth=depth, scopes=scopes, open=F.when(entry, F.concat(F.array(fresh), s["open"])).otherwise(s["open"]),
                     pos=s["pos"] + entry.cast("bigint"), field=F.when(field, t["local"]).otherwise(F.lit("")), text=F.lit(""),
                     roots=s["roots"] + (s["depth"] == 0).cast("int"), bad=bad)

    uri = lambda x: F.get(F.filter(x, lambda b: b["p"] == t["prefix"]), F.lit(0))["u"]
    return let(let(scopes, lambda x: F.struct(x.alias("scopes"), F.coalesce(uri(x), F.when(t["prefix"] == "xml", F.lit("xml")), F.lit("")).alias("ns"))), within)


def _closed(s: Column) -> Column:
    """An end tag: a ``url`` element that ends and has a ``loc`` is an entry."""
    top = F.get(s["open"], F.lit(0))
    ends = F.coalesce(top["d"] == s["depth"], F.lit(False))
    scopes = F.when(F.get(s["scopes"], F.lit(0))["d"] == s["depth"], F.filter(s["scopes"], lambda x: x["d"] < s["depth"])).otherwise(s["scopes"])
    entry = F.struct(top["pos"].alias("pos"), *(top[f].alias(f) for f in FIELDS)).cast(_ENTRY)
    kept, full = ends & top["loc"].isNotNull(), F.size(s["recent"]) >= BLOCK
    return _with(s, depth=s["depth"] - 1, scopes=scopes, open=F.when(ends, _rest(s["open"])).otherwise(s["open"]), bad=s["bad"] | (s["depth"] < 1),
                 recent=F.when(kept & full, F.array(entry)).when(kept, F.concat(s["recent"], F.array(entry))).otherwise(s["recent"]),
                 blocks=F.when(kept & full, F.concat(s["blocks"], F.array(s["recent"]))).otherwise(s["blocks"]))


def fold(tokens: Column, namespace: str | None) -> Column:
    """``struct<n, entries: array<struct<pos,loc,lastmod,changefreq,priority>>>``; null if the tags aren't one well-formed element.

    ``n`` counts the ``url`` elements; ``entries`` has those with a ``loc``.

    An entry is a ``url`` element of ``namespace`` at any depth below the
    root (None: of any namespace, the root as well);
    its fields are its first direct children of those names in its own
    namespace, with the text before their first child; null if absent.
    ``pos``: the place among all such ``url`` elements, by start tag.
    """
    def step(s: Column, t: Column) -> Column:
        reading = s["field"] != ""
        outside = (s["depth"] == 0) & ~t["text"].rlike(r"\A[ \t\r\n]*+\z")
        text = F.when(reading, _with(s, text=F.concat(s["text"], t["text"]))).when(outside, _with(s, bad=F.lit(True))).otherwise(s)
        tag = let(_settle(s), lambda x: F.when(t["kind"] == END, _closed(x)).when(t["kind"] == START, _opened(x, t, namespace)).otherwise(
            let(_opened(x, t, namespace), lambda y: let(_settle(y), _closed))))
        return F.when(t["kind"] == TEXT, text).when(t["kind"] == BAD, _with(s, bad=F.lit(True))).otherwise(tag)

    empty = "array<struct<d:int,p:string,u:string>>", f"array<{_OPEN}>", f"array<{_ENTRY}>", f"array<array<{_ENTRY}>>"
    scopes, opened, recent, blocks = (F.array().cast(x) for x in empty)
    zero = F.struct(F.lit(0).alias("depth"), scopes.alias("scopes"), opened.alias("open"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("field"),
                    F.lit("").alias("text"), F.lit(0).alias("roots"), F.lit(False).alias("bad"), recent.alias("recent"), blocks.alias("blocks")).cast(_STATE)
    return F.aggregate(tokens, zero, step, lambda s: F.when(~s["bad"] & (s["depth"] == 0) & (s["roots"] == 1), F.struct(
        s["pos"].alias("n"), F.concat(F.flatten(s["blocks"]), s["recent"]).alias("entries"))).cast(_FOUND))


# --- documents ----------------------------------------------------------------
def flat_fields(piece: Column) -> Column:
    """``struct<pos,loc,...>`` of a flat piece."""
    head = F.regexp_extract(piece, r"\A\s*+<([^>]*?)url\s*+>", 1)

    def field(name: str) -> Column:
        tag = F.concat(F.lit("<"), head, F.lit(name + ">"))
        value = F.substring_index(F.substring(piece, F.instr(piece, tag) + F.length(tag), F.lit(1 << 30)), "<", 1)
        return F.when(piece.contains(tag), decoded(value)).alias(name)
    return F.struct(F.lit(0).cast("bigint").alias("pos"), *(field(f) for f in FIELDS)).cast(_ENTRY)


def root_prefixes(root: Column, namespace: str | None) -> Column:
    """Prefixes (with their colon) that the root's tag binds to ``namespace`` (None: to any, and none at all)."""
    mine = F.filter(_bound(_attributes(root)), lambda b: (b["u"] == namespace) if namespace is not None else (b["u"] != "") & (b["p"] != ""))
    found = F.transform(mine, lambda b: F.when(b["p"] == "", F.lit("")).otherwise(F.concat(b["p"], F.lit(":"))))
    return F.array_union(found, F.array(F.lit(""))) if namespace is None else found


def is_flat(piece: Column, prefixes: Column) -> Column:
    return (piece.rlike(_FLAT_RE) & ~(piece.contains("&") & piece.rlike(_UNKNOWN_RE))
            & F.array_contains(prefixes, F.regexp_extract(piece, r"\A\s*+<([^>]*?)url\s*+>", 1)))


def cut_document(df: DataFrame, namespace: str | None) -> DataFrame:
    """Adds to ``df`` (with ``plain``, tags and text): ``root`` and ``close`` (the root's tags), ``pieces``, ``single`` and ``prefixes``."""
    root = F.regexp_extract("plain", ROOT_RE, 1)
    df = settled(df.withColumn("root", root))
    rest = F.substring(F.col("plain"), F.instr("plain", F.col("root")) + F.length("root"), F.lit(1 << 30))
    pieces = F.filter(F.regexp_extract_all(rest, F.lit(_PIECE_RE), F.lit(0)), lambda p: p != "")
    df = settled(df.withColumn("close", F.concat(F.lit("</"), F.regexp_extract("root", r"\A<([^\s/>]++)", 1), F.lit(">")))
                 .withColumn("prefixes", root_prefixes(F.col("root"), namespace)).withColumn("pieces", F.when((F.col("root") != "") & ~F.endswith("root", F.lit("/>")), pieces)))
    # a piece that begins with its only url tag is one entry of the root: what it opens it closes, as the whole is well formed
    whole = F.forall(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(1))), lambda p: p.rlike(_FIRST_RE) & (F.regexp_count(p, F.lit(URL_RE)) == 1))
    return settled(df.withColumn("single", F.coalesce((F.size("pieces") > 1) & whole & ~F.element_at("pieces", -1).rlike(URL_RE) & ~F.col("root").rlike(r"\A<(?:[^\s:>]++:)?url[\s>]"), F.lit(False))))


def document_entries(df: DataFrame, namespace: str | None) -> DataFrame:
    """``df`` (with ``plain``, null where there is nothing to read) and ``entries``, null where the tags aren't one well-formed element."""
    df = cut_document(df, namespace)
    # what the fold reads: the root alone and every piece that isn't flat, or the document
    folded = F.transform("pieces", lambda p, k: F.when((k < F.size("pieces") - 1) & ~is_flat(p, F.col("prefixes")), F.concat("root", p, "close"))
                         .when((k == F.size("pieces") - 1) & ~p.rlike(_LAST_RE), F.concat("root", p)))
    texts = F.when(F.col("single"), F.concat(F.array(F.concat("root", "close")), folded)).when(F.col("plain").isNotNull(), F.array("plain"))
    df = settled(df.withColumn("texts", texts))
    df = settled(df.withColumn("found", F.transform("texts", lambda t: F.when(t.isNotNull(), fold(tokens(t), namespace)))))
    wrong = F.exists(F.arrays_zip("texts", "found"), lambda x: x["texts"].isNotNull() & x["found"].isNull())
    # urls before each piece: its number, unless some pieces hold a url of another namespace
    other = F.exists(F.slice("found", 2, F.greatest(F.size("pieces") - 1, F.lit(1))), lambda x: x["n"] != 1)
    counts = F.transform(F.slice("found", 2, F.size("pieces")), lambda x: F.coalesce(x["n"], F.lit(1).cast("bigint")))
    sums = F.aggregate(counts, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    df = settled(df.withColumn("wrong", wrong).withColumn("before", F.when(F.col("single") & other, sums)))

    def of_piece(p: Column, k: Column) -> Column:
        read = F.get(F.col("found"), k + 1)["entries"]
        flat = F.filter(F.array(flat_fields(p)), lambda e: e["loc"].isNotNull())
        own = F.when(read.isNotNull(), read).when(k < F.size("pieces") - 1, flat).otherwise(F.array().cast(f"array<{_ENTRY}>"))
        return F.transform(own, lambda e: F.struct(F.coalesce(F.get(F.col("before"), k), k.cast("bigint")).alias("pos"), *(e[f].alias(f) for f in FIELDS)))

    apart = F.flatten(F.transform("pieces", of_piece)).cast(f"array<{_ENTRY}>")
    entries = F.when(F.col("wrong"), F.lit(None)).when(F.col("single"), apart).otherwise(F.get(F.col("found"), F.lit(0))["entries"])
    return settled(df.withColumn("entries", entries).drop("root", "close", "pieces", "prefixes", "single", "texts", "found", "wrong", "before", "plain"))

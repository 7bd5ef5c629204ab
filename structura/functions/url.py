"""URL expressions: path segments and host, with ``urllib.parse.urlparse``
semantics for the path (the part the tree and page statistics use)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Schemes for which urlparse splits ';params' off the last path segment.
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
               "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# ---------------------------------------------------------------------------

LEAD_C0_RE = r"\A[\x{0}-\x{20}]+"          # urlsplit strips C0 controls and space in front
UNSAFE_RE = r"[\t\r\n]"                     # and removes tab, CR, LF anywhere
SCHEME_RE = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
PATH_RE = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
PARAMS_RE = r";[^/]*\z"
HOST_RE = r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def clean_url(url: Column) -> Column:
    """``LEAD_C0_RE``, then ``UNSAFE_RE`` removed; spelt without patterns, as every URL is read by it.

    Most URLs have none of these; looking for them costs far less than removing them."""
    odd = (url < "!") | F.contains(url, F.lit("\t")) | F.contains(url, F.lit("\r")) | F.contains(url, F.lit("\n"))
    return F.when(odd, F.translate(F.ltrim(url, F.lit("".join(map(chr, range(0x21))))), "\t\r\n", "")).otherwise(url)


def url_path(url: Column) -> Column:
    """The path component, as ``urlparse(url).path``."""
    u = clean_url(url)
    path = F.regexp_extract(u, PATH_RE, 1)
    scheme = F.lower(F.regexp_extract(u, SCHEME_RE, 1))
    return F.when(F.contains(path, F.lit(";")) & scheme.isin(*USES_PARAMS), F.regexp_replace(path, PARAMS_RE, "")).otherwise(path)


def path_segments(url: Column) -> Column:
    """The path's segments; empty ones (leading, trailing and doubled slashes) are left out."""
    return F.array_remove(F.split(url_path(url), "/"), "")


def segment_path(path: Column) -> Column:
    """A path's segments joined by '/', as of ``path_segments``, without an array of them."""
    inner = F.btrim(path, F.lit("/"))
    return F.when(F.contains(inner, F.lit("//")), F.regexp_replace(inner, "/{2,}", "/")).otherwise(inner)


def url_host(url: Column) -> Column:
    """Lower-cased network location (including any port), '' when absent."""
    return F.lower(F.regexp_extract(clean_url(url), HOST_RE, 1))


# DuckDB twins -----------------------------------------------------------------

def duck_path(expr: str) -> str:
    from .text import sql_list, sql_str
    u = (f"regexp_replace(regexp_replace({expr}, {sql_str(LEAD_C0_RE)}, '', 'g'), "
         f"{sql_str(UNSAFE_RE)}, '', 'g')")
    path = f"regexp_extract({u}, {sql_str(PATH_RE)}, 1)"
    scheme = f"lower(regexp_extract({u}, {sql_str(SCHEME_RE)}, 1))"
    return (f"(CASE WHEN {scheme} IN {sql_list(USES_PARAMS)} "
            f"THEN regexp_replace({path}, {sql_str(PARAMS_RE)}, '') ELSE {path} END)")


def duck_segments(expr: str) -> str:
    return f"list_filter(string_split({duck_path(expr)}, '/'), lambda s: s <> '')"


def duck_host(expr: str) -> str:
    from .text import sql_str
    u = (f"regexp_replace(regexp_replace({expr}, {sql_str(LEAD_C0_RE)}, '', 'g'), "
         f"{sql_str(UNSAFE_RE)}, '', 'g')")
    return f"lower(regexp_extract({u}, {sql_str(HOST_RE)}, 1))"

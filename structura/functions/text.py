"""String helpers written as native column expressions.

Every pattern here is chosen to mean the same thing in Java regex (Spark)
and RE2 (the DuckDB oracle): no look-around, no possessive quantifiers,
code points written as ``\\x{..}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The characters Python's str.strip() removes (str.isspace), as one class:
# U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028,
# U+2029, U+202F, U+205F, U+3000.
PY_WS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# pandas' default NA tokens (exact, case-sensitive match on the raw field).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# ---------------------------------------------------------------------------

STRIP_RE = r"\A" + PY_WS + r"+|" + PY_WS + r"+\z"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` semantics (all Unicode whitespace, both ends)."""
    return F.regexp_replace(c, STRIP_RE, "")


def is_blank(c: Column) -> Column:
    """True when the string is empty after Python strip (null stays null)."""
    return F.length(py_strip(c)) == 0


def slug(c: Column) -> Column:
    """lower-case, every run of characters outside [a-z0-9] becomes '-'."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def na_to_null(c: Column) -> Column:
    """Map pandas NA tokens to null, keep every other value verbatim."""
    return F.when(~c.isin(*NA_TOKENS), c)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL literal (for the oracle twins)."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def duck_strip(expr: str) -> str:
    """DuckDB twin of :func:`py_strip`."""
    return f"regexp_replace({expr}, {sql_str(STRIP_RE)}, '', 'g')"

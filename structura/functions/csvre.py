"""CSV record and cell patterns (a dialect: one delimiter, one quote character
that is doubled inside quotes) in Java regex.

All repeats are possessive: no field can be read in two ways, so nothing is
lost, and Java runs them as loops.  Greedy repeats of a group recurse once
per turn and overflow the stack on a cell with thousands of doubled quotes.

A field is one of
  * a quoted field ``"..."`` with doubled quotes inside, then any junk up to
    the next delimiter (Python's csv keeps that junk),
  * an unclosed quoted field running to the end of the text,
  * a plain field that does not start with a quote (it may hold quotes),
  * nothing.
A record is fields joined by the delimiter, ended by ``\\n`` or the end.
Newlines inside quoted fields stay in the record, so no line window is
needed to assemble multi-line records.
"""

from __future__ import annotations

import re


def _d(delim: str) -> str:
    return re.escape(delim) if delim not in "\t" else r"\t"


def field_re(delim: str = ",", quote: str = '"') -> str:
    d, q = _d(delim), quote
    open_quoted = f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    return (f"(?:{open_quoted}{q}[^{d}\\n{q}]*+"
            rf"|{open_quoted}\z"
            f"|[^{d}{q}\\n][^{d}\\n]*+)?+")


def record_re(delim: str = ",", quote: str = '"') -> str:
    d = _d(delim)
    f = field_re(delim, quote)
    return f"({f}(?:{d}{f})*+)(?:\\n|\\z)"


def cell_re(delim: str = ",", quote: str = '"') -> str:
    """Applied to ``delim + record``: group 1 is one raw cell."""
    d = _d(delim)
    return f"{d}({field_re(delim, quote)})"


def unclosed_re(delim: str = ",", quote: str = '"') -> str:
    """A record whose last field opens a quote that never closes.  Anchored
    at the record start and read field by field, so a quoted cell that ends
    in ``,"`` is not mistaken for a delimiter plus an opening quote."""
    d, q = _d(delim), quote
    closed = f"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}[^{d}\\n{q}]*+|[^{d}{q}\\n][^{d}\\n]*+)?+"
    return f"\\A(?:{closed}{d})*+{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+\\z"


def quoted_cell_re(quote: str = '"') -> str:
    """Quoted cell: inner text (doubled quotes, newlines allowed) and the junk after the closing quote."""
    q = quote
    return rf"\A{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+){q}([^{q}]*+)\z"

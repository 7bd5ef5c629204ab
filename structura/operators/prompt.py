"""Prompt assembly (M1, M2), batch generation (M3) and the rule-based
default generator.

M1 keeps the first 50 pairs of a questionnaire in id order and notes how
many more there are.  Two plans give the same rows:

* :func:`file_prompt_context` works on parsed files, where a file's pairs
  are already an array in one row: slice + size, no shuffle at all.
* :func:`prompt_context` takes any pair table.  ``row_number() <= k`` over
  ``(file_id ORDER BY id)`` lets Spark limit every group on the map side
  before the shuffle (a partial window group limit), so a file holding a
  third of all pairs still moves only ``k`` rows per map task; the count
  per file is a partial aggregation.

M3 runs a caller-supplied generator inside ``mapInPandas``; the only
Python on executors in the library.  Failures are captured per row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from . import rule_tables as RT
from .ingest import _explode, _one_if, pair_array
from .rules import apply_rules, planned_pages, questionnaire_profile
from .sitemap import SITEMAP_NS, sitemap_write

# --- fixed values -----------------------------------------------------------
MAX_PAIRS = 50                                   # pairs placed in the prompt
PAIR_FORMAT = ("Question ", ": ", "\nAnswer: ")  # Question {id}: {q}\nAnswer: {a}
PAIR_SEP = "\n\n"
MORE_FORMAT = ("\n\n... and ", " more question-answer pairs.")
# ---------------------------------------------------------------------------

REPLY_SCHEMA = "file_id string, response string, error string"
SITE_BASE = "https://example.com/"


def pair_entry(id_: Column, q: Column, a: Column) -> Column:
    return F.concat(F.lit(PAIR_FORMAT[0]), id_.cast("string"), F.lit(PAIR_FORMAT[1]), q,
                    F.lit(PAIR_FORMAT[2]), a)


def _more(n: Column, k: int | None) -> Column:
    if k is None:
        return F.lit("")
    return F.when(n > k, F.concat(F.lit(MORE_FORMAT[0]), (n - k).cast("string"), F.lit(MORE_FORMAT[1]))) \
        .otherwise(F.lit(""))


def file_prompt_context(parsed: DataFrame, k: int | None = MAX_PAIRS) -> DataFrame:
    """M1 on parsed files: ``file_id, n_pairs, qa_text`` (files with pairs).

    The first ``k`` pairs and the number of those left out (None: all pairs).

    The "has pairs" test sits inside the row (a 0/1-element array that is
    exploded), not in a ``filter``: a filter on a computed column would be
    pushed below the projection and re-run the whole per-file parse.
    """
    pairs = parsed.select("file_id", pair_array(parsed).alias("pairs"))
    head = F.transform(F.slice("pairs", 1, k) if k is not None else F.col("pairs"), lambda p: pair_entry(p["id"], p["question"], p["answer"]))
    n = F.size("pairs").cast("bigint")
    one = _one_if(n > 0, F.struct(n.alias("n_pairs"),
                                  F.concat(F.array_join(head, PAIR_SEP), _more(n, k)).alias("qa_text")))
    return _explode(pairs, one).select("file_id", "r.n_pairs", "r.qa_text")


def prompt_context(pairs: DataFrame, k: int | None = MAX_PAIRS) -> DataFrame:
    """M1 on any ``file_id, id, question, answer`` table; ``k`` None: all pairs.

    Both the first pairs and the totals read the pairs: they are written once, as a parse of all files may lie behind them."""
    pairs = materialize(pairs.select("file_id", "id", "question", "answer"), "pairs")
    w = Window.partitionBy("file_id").orderBy("id")
    top = pairs if k is None else pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    top = (top.select("file_id", "id", pair_entry(F.col("id"), F.col("question"), F.col("answer")).alias("e")))
    head = (top.groupBy("file_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "e"))),
                                          lambda s: s["e"]), PAIR_SEP).alias("head")))
    totals = pairs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return (head.join(totals, "file_id")
            .select("file_id", "n_pairs", F.concat("head", _more(F.col("n_pairs"), k)).alias("qa_text")))


# --- M2 ---------------------------------------------------------------------
def _rules_text() -> str:
    """Our own wording of the rules, rendered from the rule tables."""
    excl = ", ".join(sorted(RT.EXCLUDED_SEGMENTS))
    ld = "; ".join(f"/{a} needs /{a}/{b}" for a, b in RT.LISTING_DETAIL)
    ind = "; ".join(f"{k}: " + ", ".join("/" + p for p in v) for k, v in RT.INDUSTRY_PAGES.items())
    legal = "; ".join(f"{t} -> /{p}" for t, p in RT.LEGAL_PAGES)
    classes = "; ".join(f"{c} ({pat}) priority {p}, {cf}, lastmod within {w} days"
                        for c, pat, p, cf, w in RT.PAGE_CLASSES)
    dc = RT.DEFAULT_CLASS
    return "\n".join([
        "Site-structure rules:",
        f"1. Leave out non-pages: paths with a segment in [{excl}]; search, filter and paginated URLs; "
        "bare language prefixes.",
        f"2. Each listing has a detail template: {ld}.",
        f"3. Every page's parent exists; at most {RT.MAX_LEVELS} levels below the homepage.",
        f"4. Industry pages: {ind}.",
        f"5. Legal pages by trait: {legal}.",
        f"6. Languages: '{RT.ML_DEFAULT}' approach (?{RT.ML_PARAM}=xx) unless the questionnaire says otherwise.",
        f"7. Page classes: {classes}; any other page priority {dc[1]}, {dc[2]}, within {dc[3]} days.",
        f"8. URL style: lower case, hyphens, no underscores or special characters, no leading digits, "
        f"no double slashes, at most {RT.LINT_MAX_DEPTH} segments and {RT.LINT_MAX_LENGTH} characters, "
        "no trailing slash.",
    ])


def prompt_template() -> tuple[str, str]:
    """(text before the questionnaire, text after it); ``{date}`` is filled in."""
    head = ("Task: design the page structure of a website from the client questionnaire below "
            "and return it as an XML sitemap.\nDate: {date}\n\n" + _rules_text() + "\n\nQuestionnaire:\n")
    tail = (f"\n\nReply with a short analysis, then one ```xml fenced <urlset xmlns=\"{SITEMAP_NS}\"> "
            "document with loc, lastmod, changefreq and priority for every page.")
    return head, tail


def prompt_render(ctx: DataFrame, anchor: _dt.date | str) -> DataFrame:
    """M2: ``file_id, n_pairs, qa_text, prompt``."""
    head, tail = prompt_template()
    head = head.replace("{date}", str(anchor))
    return ctx.withColumn("prompt", F.concat(F.lit(head), F.col("qa_text"), F.lit(tail)))


# --- M3 ---------------------------------------------------------------------
def generate_batch(prompts: DataFrame, generator: Callable[[list[str]], list[str]],
                   id_col: str = "file_id", prompt_col: str = "prompt") -> DataFrame:
    """M3: ``file_id, response, error`` from ``generator(prompts)``, called
    with the prompts of one Arrow batch and giving one reply for each.

    Runs in ``mapInPandas``; the generator is shipped to the executors.  If
    a call fails, its prompts are tried one by one, and the exception of a
    prompt becomes that row's ``error`` instead of failing the task.  A
    re-run task calls the generator again, so write the result to a table
    before reading it more than once.
    """
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return generator([prompt])[0], None
            except Exception as e:  # noqa: BLE001 - any failure is reported per row
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            asked = list(pdf[prompt_col])
            try:
                replies = [(r, None) for r in generator(asked)] if asked else []
                if len(replies) != len(asked):
                    raise ValueError("not one reply per prompt")
            except Exception:  # noqa: BLE001
                replies = [one(p) for p in asked]
            yield pd.DataFrame({"file_id": pdf[id_col].astype(str), "response": [r for r, _ in replies], "error": [e for _, e in replies]})

    return prompts.select(id_col, prompt_col).mapInPandas(run, REPLY_SCHEMA)


def rule_based_sitemaps(pairs: DataFrame, anchor: _dt.date | str) -> DataFrame:
    """The default generator, all in Spark: questionnaire profile (V12) ->
    planned pages -> priority, changefreq and lastmod (V7-V9) -> sitemap
    XML (S4).  ``file_id, n_urls, xml``."""
    pages = planned_pages(questionnaire_profile(pairs))
    urls = pages.select(F.col("file_id").alias("site_id"), F.col("path"),
                        F.concat(F.lit(SITE_BASE), F.col("path")).alias("url"))
    # Document order: homepage first, then by path (a per-file sort of a
    # bounded page set: base + 2 per dynamic type + industry + legal pages).
    ordered = urls.withColumn("pos", F.row_number().over(
        Window.partitionBy("site_id").orderBy(F.col("path") != "", "path")))
    rec = apply_rules(ordered.select("site_id", "pos", "url"), anchor)
    rec = rec.select("site_id", "pos", "url", F.col("lastmod").cast("string").alias("lastmod"),
                     "changefreq", F.col("priority").cast("string").alias("priority"))
    return (sitemap_write(rec).select(F.col("site_id").alias("file_id"), "n_urls", "xml"))


def rule_based_replies(pairs: DataFrame, anchor: _dt.date | str) -> DataFrame:
    """Replies in the shape a model gives (fenced XML), ``REPLY_SCHEMA``."""
    s = rule_based_sitemaps(pairs, anchor)
    return s.select("file_id", F.concat(F.lit("```xml\n"), F.col("xml"), F.lit("```")).alias("response"),
                    F.lit(None).cast("string").alias("error"))

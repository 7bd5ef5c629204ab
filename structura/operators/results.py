"""The whole way of a questionnaire, one result row per file.

Pairs -> reply -> XML out of the reply -> URL records -> tree lines and page
statistics -> output name, or the reason why there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .ingest import client_name, output_name, pair_array
from .sitemap import extract_xml, sitemap_parse
from .tree import page_stats, tree_lines


def file_facts(parsed: DataFrame) -> DataFrame:
    """What the later steps need of every file, written once: ``file_id, status, n_rows, n_columns, client_name, pairs``."""
    facts = parsed.select("file_id", "status", F.size("rows").alias("n_rows"), F.coalesce(F.size("header"), F.lit(0)).alias("n_columns"),
                          pair_array(parsed).alias("pairs"), client_name(parsed).alias("client_name"))
    facts = materialize(facts, "file-parsed")  # one parse: both sides of the join read what it wrote
    client = facts.filter(F.col("status") == "ok").select("file_id", "client_name")
    return materialize(facts.drop("client_name").join(client, "file_id", "left"), "file-facts")


def pairs_of(facts: DataFrame) -> DataFrame:
    """R2 from the written facts: ``file_id, id, question, answer``."""
    return (facts.select("file_id", F.explode_outer("pairs").alias("p")).filter("p is not null")
            .select("file_id", "p.id", "p.question", "p.answer"))


def site_records(replies: DataFrame) -> DataFrame:
    """URL records of the replies (``file_id, response, error``): ``site_id`` is the file."""
    n = int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = replies.select("file_id", "response").repartition(n, "file_id")  # written replies are few bytes in few files, but long to parse
    xml = spread.filter("response is not null").select(F.col("file_id").alias("site_id"), extract_xml(F.col("response")).alias("xml"))
    return sitemap_parse(xml, ("site_id",))


def site_results(facts: DataFrame, replies: DataFrame, run_ts: Column) -> DataFrame:
    """``file_id, n_rows, n_columns, n_pairs, n_urls, main_pages, subpages, n_lines, client_name, output_name, error``.

    ``error``: the status of an unreadable file, ``no_pairs``, the
    generator's message, ``no_reply``, or ``no_urls``; null when all went well.
    """
    records = materialize(site_records(replies), "site-records")
    lines = tree_lines(records).groupBy("site_id").agg(F.count("*").alias("n_lines"))
    said = replies.select("file_id", F.col("error").alias("said"), F.col("response").isNotNull().alias("replied"))
    n_pairs = F.coalesce(F.size("pairs"), F.lit(0))
    j = (facts.join(said, "file_id", "left")
         .join(page_stats(records).withColumnRenamed("site_id", "file_id"), "file_id", "left")
         .join(lines.withColumnRenamed("site_id", "file_id"), "file_id", "left"))
    error = (F.when(F.col("status") != "ok", F.col("status")).when(n_pairs <= 0, F.lit("no_pairs"))
             .when(F.col("said").isNotNull(), F.col("said")).when(~F.coalesce("replied", F.lit(False)), F.lit("no_reply"))
             .when(F.col("total_pages").isNull(), F.lit("no_urls")))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_urls" if c == "total_pages" else c)
    return j.select("file_id", "n_rows", "n_columns", F.greatest(n_pairs, F.lit(0)).cast("bigint").alias("n_pairs"), count("total_pages"), count("main_pages"),
                    count("subpages"), count("n_lines"), "client_name", output_name(F.col("client_name"), run_ts).alias("output_name"), error.alias("error"))

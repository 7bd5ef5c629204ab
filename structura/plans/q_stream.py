"""Queries for G1 (incremental ingest) and S3 (tree files).  Both write
under the session's shared ``spark.checkpoint.dir`` and read the result
back, so they exercise the real file paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as T
from ..operators.ingest import parse_files, qa_pairs
from ..operators.ingest_split import parse_split, split_pairs
from ..operators.sitemap import sitemap_parse
from ..operators.sitemap_split import sitemap_parse_files
from ..operators.sinks import read_sitemap_lines, read_tree_files, site_output_names, write_sitemap_files, write_tree_files
from ..functions.scratch import scratch_path
from ..sources.fixtures import catalog_urls, page_urls, qfiles_text, sitemap_docs
from ..sources.tables import binary_files, xml_texts
from ..streaming.ingest_stream import read_pairs, start_ingest_stream
from .q_ingest import _PAIRS_TRUTH
from .q_sitemap import PARSE_CTE, WRITE_CTE
from .registry import register
from .sqlparts import catalog_cte, nodes_cte, ordered_cte, qa_source_cte

RUN_TS = "2025-01-01 12:00:00"


@register("stream_ingest", f"WITH {qa_source_cte()}" + _PAIRS_TRUTH)
def q_stream_ingest(spark, sf):
    landing, out, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "pairs"), scratch_path(spark, "stream-ckpt")
    # The landing folder: one text file per questionnaire, in a folder per file id.
    (qfiles_text(spark, sf).select("file_id", "text")
     .write.partitionBy("file_id").text(landing))
    q = start_ingest_stream(spark, landing, out, ckpt, glob="*.txt", file_id_re=r"file_id=([^/]+)/")
    q.awaitTermination()
    return read_pairs(spark, out).select("file_id", "id", "question", "answer")


@register("files_ingest", f"WITH {qa_source_cte()}" + _PAIRS_TRUTH)
def q_files_ingest(spark, sf):
    """S1 in batch: questionnaire files written to a folder and read as files."""
    landing = scratch_path(spark, "files")
    qfiles_text(spark, sf).select("file_id", "text").write.partitionBy("file_id").text(landing)
    files = binary_files(spark, landing, glob="*.txt")
    return qa_pairs(parse_files(files.withColumn("file_id", F.regexp_extract("file_id", r"file_id=([^/]+)/", 1))))


@register("qa_pairs_split", f"WITH {qa_source_cte()}" + _PAIRS_TRUTH)
def q_qa_pairs_split(spark, sf):
    """S1, I1-I9 and R2 from files that many tasks may share."""
    landing = scratch_path(spark, "files")
    qfiles_text(spark, sf).select("file_id", "text").write.partitionBy("file_id").text(landing)
    return split_pairs(parse_split(spark, landing, "*.txt", r"file_id=([^/]+)/"))


@register("sitemap_files", f"WITH {PARSE_CTE} SELECT * EXCLUDE (chunk) FROM structured UNION ALL SELECT * EXCLUDE (chunk) FROM fallback")
def q_sitemap_files(spark, sf):
    """S2 from files: one sitemap per file, read whole."""
    folder = scratch_path(spark, "sitemaps")
    sitemap_docs(spark, sf).select("site_id", "xml").write.partitionBy("site_id").text(folder)
    docs = xml_texts(spark, folder)
    return sitemap_parse(docs.withColumn("site_id", F.regexp_extract("site_id", r"site_id=([^/]+)/", 1)))


@register("sitemap_records_split", f"WITH {PARSE_CTE} SELECT * EXCLUDE (chunk) FROM structured UNION ALL SELECT * EXCLUDE (chunk) FROM fallback")
def q_sitemap_records_split(spark, sf):
    """S2 from files that many tasks may share."""
    folder = scratch_path(spark, "sitemaps")
    sitemap_docs(spark, sf).select("site_id", "xml").write.partitionBy("site_id").text(folder)
    return sitemap_parse_files(spark, folder, file_id_re=r"site_id=([^/]+)/")


@register("tree_files", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', T.TREE_MAX_DEPTH)},
{ordered_cte('nodes', 'ordered')}
SELECT site_id, 'sitemap_structure-' || site_id || '.txt' AS output_name, line_no, repeat('  ', depth) || '• ' || name AS line
FROM ordered""")
def q_tree_files(spark, sf):
    urls = catalog_urls(spark, sf, shorten=True)
    path = scratch_path(spark, "tree-files")
    write_tree_files(T.tree_lines(urls), site_output_names(urls, RUN_TS), path)
    return read_tree_files(spark, path)


@register("sitemap_write_files", f"""
WITH {WRITE_CTE}
SELECT site_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line
FROM (SELECT site_id, string_split(regexp_replace(xml, '\\n$', ''), chr(10)) AS l FROM written)""")
def q_sitemap_write_files(spark, sf):
    """S4 through ordered part files."""
    path = scratch_path(spark, "sitemap-files")
    write_sitemap_files(page_urls(spark, sf), path)
    return read_sitemap_lines(spark, path)

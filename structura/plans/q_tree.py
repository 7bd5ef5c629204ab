"""Queries for T1-T8, page statistics and the URL list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.url import duck_path, duck_segments, url_path
from ..operators import tree as T
from ..sources.fixtures import catalog_urls, page_urls
from .registry import register
from .sqlparts import catalog_cte, nodes_cte, ordered_cte, page_urls_cte

CHUNK = T.TEXT_CHUNK_LINES


@register("url_segments", f"""
WITH {page_urls_cte()}
SELECT site_id, pos, url, {duck_path('url')} AS path,
       CAST(len({duck_segments('url')}) AS INTEGER) AS n_segments,
       array_to_string({duck_segments('url')}, '/') AS seg_path
FROM urls""")
def q_url_segments(spark, sf):
    s = T.url_segments(page_urls(spark, sf))
    return s.select("site_id", "pos", "url", url_path(F.col("url")).alias("path"), "n_segments",
                    F.array_join("segs", "/").alias("seg_path"))


_STATS_SQL = """
SELECT site_id, count(*) AS total_pages,
       count(*) FILTER (WHERE n <= 1) AS main_pages,
       count(*) FILTER (WHERE n >= 2) AS subpages
FROM (SELECT site_id, len({segs}) AS n FROM urls) GROUP BY site_id"""


@register("page_stats", f"WITH {page_urls_cte()}" + _STATS_SQL.format(segs=duck_segments("url")),
          )
def q_page_stats(spark, sf):
    return T.page_stats(page_urls(spark, sf))


@register("page_stats_catalog",
          f"WITH {catalog_cte(shorten=True)}" + _STATS_SQL.format(segs=duck_segments("url")),
          )
def q_page_stats_catalog(spark, sf):
    return T.page_stats(catalog_urls(spark, sf, shorten=True))


@register("url_list", f"""
WITH {page_urls_cte()}
SELECT site_id, pos, '- `' || url || '`' AS line FROM urls""")
def q_url_list(spark, sf):
    return T.url_list(page_urls(spark, sf))


@register("tree_nodes", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', None)}
SELECT * FROM nodes""")
def q_tree_nodes(spark, sf):
    return T.tree_nodes(catalog_urls(spark, sf, shorten=True))


_LINES_SQL = """
SELECT site_id, line_no, depth, repeat('  ', depth) || '• ' || name AS line FROM ordered"""


@register("tree_lines", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', T.TREE_MAX_DEPTH)},
{ordered_cte('nodes', 'ordered')}""" + _LINES_SQL)
def q_tree_lines(spark, sf):
    return T.tree_lines(catalog_urls(spark, sf, shorten=True))


@register("tree_lines_pages", f"""
WITH {page_urls_cte()}, {nodes_cte('urls', 'nodes', T.TREE_MAX_DEPTH)},
{ordered_cte('nodes', 'ordered')}""" + _LINES_SQL)
def q_tree_lines_pages(spark, sf):
    return T.tree_lines(page_urls(spark, sf))


@register("tree_text", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', T.TREE_MAX_DEPTH)},
{ordered_cte('nodes', 'ordered')},
lines AS ({_LINES_SQL})
SELECT site_id, CAST((line_no - 1) // {CHUNK} AS BIGINT) AS chunk, count(*) AS n_lines,
       string_agg(line, chr(10) ORDER BY line_no) AS text
FROM lines GROUP BY site_id, (line_no - 1) // {CHUNK}""")
def q_tree_text(spark, sf):
    return T.tree_text(T.tree_lines(catalog_urls(spark, sf, shorten=True)))


_GRAPH_SQL = f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', T.GRAPH_MAX_DEPTH + 1)},
g AS (SELECT * FROM nodes WHERE depth <= {T.GRAPH_MAX_DEPTH}),
{ordered_cte('g', 'ordered')},
withid AS (
  SELECT o.*, 'node_' || o.depth || '_' || o.sibling_idx || '_' ||
         replace(replace(o.name, '/', '_'), ' ', '_') AS node_id
  FROM ordered o),
gnodes AS (
  SELECT w.site_id, w.node_id, w.name, w.path, w.depth,
         EXISTS (SELECT 1 FROM nodes c WHERE c.site_id = w.site_id AND c.parent_path = w.path) AS is_folder,
         w.parent_path, coalesce(p.node_id, 'root') AS parent_id, w.sibling_idx, w.line_no AS edge_no
  FROM withid w LEFT JOIN withid p ON p.site_id = w.site_id AND p.path = w.parent_path)"""


@register("graph_nodes", _GRAPH_SQL + "\nSELECT * FROM gnodes")
def q_graph_nodes(spark, sf):
    return T.graph_nodes(catalog_urls(spark, sf, shorten=True))


_EDGES = """
SELECT site_id, edge_no, parent_id AS from_id, node_id AS to_id,
       coalesce(parent_path, 'root') AS from_path, path AS to_path FROM gnodes"""


@register("graph_edges", _GRAPH_SQL + _EDGES)
def q_graph_edges(spark, sf):
    return T.graph_edges(T.graph_nodes(catalog_urls(spark, sf, shorten=True)))


@register("graph_edges_top", _GRAPH_SQL + _EDGES + f" WHERE edge_no <= {T.GRAPH_MAX_EDGES}")
def q_graph_edges_top(spark, sf):
    return T.graph_edges_top(catalog_urls(spark, sf, shorten=True))


@register("tree_lines_unlimited", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', None)},
{ordered_cte('nodes', 'ordered')}""" + _LINES_SQL)
def q_tree_lines_unlimited(spark, sf):
    return T.tree_lines(catalog_urls(spark, sf, shorten=True), max_depth=None)


@register("tree_hidden_nodes", f"""
WITH {catalog_cte(shorten=True)}, {nodes_cte('urls', 'nodes', None)}
SELECT site_id, count(*) FILTER (WHERE depth <= {T.TREE_MAX_DEPTH}) AS n_printed,
       count(*) FILTER (WHERE depth > {T.TREE_MAX_DEPTH}) AS n_hidden FROM nodes GROUP BY site_id""")
def q_tree_hidden_nodes(spark, sf):
    return T.hidden_nodes(catalog_urls(spark, sf, shorten=True))

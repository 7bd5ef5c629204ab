"""URL tree: segments, nodes, depth-first order, printed lines, graph.

Input everywhere is a URL-record table ``site_id, pos, url`` where ``pos``
is a unique ordinal in document order within the site (dense or sparse).

The reference builds a trie per sitemap and prints it recursively with
siblings in first-appearance order.  Here the trie is a flat node table
``(site_id, path)``.  A node's sort key lists the first appearances of its
ancestors and its own; depth-first order is the order of these keys, so line
numbers are ranks of one distributed sort.  Ancestors come from one pass over
the sorted paths (``functions.ancestors``), not from joins on the parent: a
node moves three times, and neither a large site nor a large sibling group
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ancestors import with_ancestors
from ..functions.joins import join_group_facts
from ..functions.order import ranked, ranked_in_many
from ..functions.scratch import materialize
from ..functions.url import path_segments

# --- fixed values -----------------------------------------------------------
TREE_MAX_DEPTH = 6      # printed levels 0..6
GRAPH_MAX_DEPTH = 4     # graph levels 0..4
GRAPH_MAX_EDGES = 200   # edges drawn
BULLET = "• "
INDENT = "  "
# ---------------------------------------------------------------------------

TEXT_CHUNK_LINES = 10_000


def url_segments(urls: DataFrame) -> DataFrame:
    """``site_id, pos, url, segs ARRAY<STRING>, n_segments``."""
    segs = path_segments(F.col("url"))
    return (urls.select("site_id", "pos", "url", segs.alias("segs"))
            .withColumn("n_segments", F.size("segs")))


def page_stats(urls: DataFrame) -> DataFrame:
    """Total / main (<= 1 segment, homepage included) / sub pages per site.

    Duplicates count; the aggregation is partial (map-side) so a hot site
    costs one row per map task in the shuffle.
    """
    n = F.size(path_segments(F.col("url")))
    return (urls.select("site_id", n.alias("n"))
            .groupBy("site_id")
            .agg(F.count(F.lit(1)).alias("total_pages"),
                 F.count_if(F.col("n") <= 1).alias("main_pages"),
                 F.count_if(F.col("n") >= 2).alias("subpages")))


def url_list(urls: DataFrame) -> DataFrame:
    """Fallback display, one markdown line per URL record."""
    return urls.select("site_id", "pos", F.concat(F.lit("- `"), F.col("url"), F.lit("`")).alias("line"))


def tree_nodes(urls: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``site_id, path, parent_path, name, depth, first_seen``.

    Every prefix of every path is a node; ``first_seen`` is the smallest
    ``pos`` that contains it.  ``max_depth`` (0-based) prunes deeper
    prefixes before the shuffle.
    """
    whole = urls.select("site_id", "pos", F.array_join(path_segments(F.col("url")), "/").alias("whole"))
    n = _depth("whole") + 1
    if max_depth is not None:
        n = F.least(n, F.lit(max_depth + 1))
    # outer: no filter is inferred that would cut the URL again
    ex = whole.select("site_id", "pos", "whole", F.explode_outer(F.when((F.col("whole") != "") & (n > 0), F.sequence(F.lit(1), n))).alias("n")).filter("n is not null")
    prefixes = ex.select("site_id", "pos", F.expr("substring_index(whole, '/', n)").alias("path"))
    return _node_columns(prefixes.groupBy("site_id", "path").agg(F.min("pos").alias("first_seen")))


def _depth(path: str) -> F.Column:
    return F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))


def _node_columns(nodes: DataFrame, *more: str) -> DataFrame:
    name, depth = F.substring_index("path", "/", -1), _depth("path")
    return nodes.select(
        "site_id", "path",
        F.when(depth > 0, F.left(F.col("path"), F.length("path") - F.length(name) - 1)).alias("parent_path"),
        name.alias("name"),
        depth.alias("depth"),
        "first_seen", *more,
    )


def _keyed(nodes: DataFrame) -> DataFrame:
    """``site_id, path, first_seen, key`` of ``nodes``; ``key``: the ``first_seen`` of the ancestors and of the node itself.

    No join on a parent: a parent of very many children spreads over tasks.
    """
    placed = with_ancestors(nodes.select("site_id", "path", F.col("first_seen").alias("value")))
    return placed.select("site_id", "path", F.col("value").alias("first_seen"), F.concat("above", F.array("value")).alias("key"))


def dfs_order(nodes: DataFrame) -> DataFrame:
    """Add ``line_no`` (1-based depth-first rank, siblings by first_seen)
    to a node table that is closed under ancestors (every node's parent is
    present)."""
    rows = ranked(_keyed(nodes), ["site_id"], ["key"], "line_no", keep_order=False)  # what the path says is worked out behind the sort
    return _node_columns(rows.withColumn("line_no", F.col("line_no") + 1), "line_no")


def with_sibling_idx(ordered: DataFrame) -> DataFrame:
    """Adds ``sibling_idx``, the 0-based rank among siblings."""
    keyed = ordered.withColumn("parent_key", F.coalesce("parent_path", F.lit("")))
    return ranked_in_many(keyed, ["site_id", "parent_key"], ["first_seen"], "sibling_idx").drop("parent_key")


def tree_lines(urls: DataFrame, max_depth: int | None = TREE_MAX_DEPTH) -> DataFrame:
    """T3+T4: printed tree lines ``site_id, line_no, depth, line``.

    Deeper nodes are left out (None: no limit); :func:`hidden_nodes` counts them."""
    ordered = dfs_order(tree_nodes(urls, max_depth))
    line = F.concat(F.repeat(F.lit(INDENT), F.col("depth")), F.lit(BULLET), F.col("name"))
    return ordered.select("site_id", "line_no", "depth", line.alias("line"))


def hidden_nodes(urls: DataFrame, max_depth: int = TREE_MAX_DEPTH) -> DataFrame:
    """Per site the nodes that ``tree_lines`` prints and those below its depth: ``site_id, n_printed, n_hidden``."""
    return (tree_nodes(urls).groupBy("site_id")
            .agg(F.count_if(F.col("depth") <= max_depth).alias("n_printed"),
                 F.count_if(F.col("depth") > max_depth).alias("n_hidden")))


def tree_text(lines: DataFrame, chunk_lines: int = TEXT_CHUNK_LINES) -> DataFrame:
    """T5: the tree as text, ``site_id, chunk, n_lines, text``.

    Lines are joined with '\\n' in line order.  A site's text is cut into
    chunks of ``chunk_lines`` consecutive lines so no group is unbounded;
    a site with fewer lines is exactly one chunk (the reference's string),
    and concatenating a site's chunks with '\\n' in chunk order restores it.
    """
    chunk = F.floor((F.col("line_no") - 1) / chunk_lines).cast("bigint")
    return (lines.withColumn("chunk", chunk)
            .groupBy("site_id", "chunk")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))),
                                          lambda s: s["line"]), "\n").alias("text")))


def _node_id(depth: F.Column, idx: F.Column, name: F.Column) -> F.Column:
    label = F.replace(F.replace(name, F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("node_"), depth.cast("string"), F.lit("_"), idx.cast("string"), F.lit("_"), label)


def graph_nodes(urls: DataFrame, max_depth: int | None = GRAPH_MAX_DEPTH) -> DataFrame:
    """``site_id, node_id, name, path, depth, is_folder, parent_path,
    parent_id, sibling_idx, edge_no``.

    ``is_folder`` looks one level past the cut (a depth-4 node with children
    is a folder even though they are not drawn).  ``edge_no`` is the
    traversal rank of the edge into the node.  ``max_depth`` None: all depths.
    """
    if max_depth is None:
        nodes = materialize(tree_nodes(urls), "graph-nodes")
        return _graph(nodes, with_sibling_idx(dfs_order(nodes)))
    nodes = materialize(tree_nodes(urls, max_depth + 1), "graph-nodes")
    return _graph(nodes, with_sibling_idx(dfs_order(nodes.filter(F.col("depth") <= max_depth))))


def _graph(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Children meet their parent's id by a join that broadcasts the few parents of very many (``join_group_facts``)."""
    families = (nodes.filter(F.col("parent_path").isNotNull()).groupBy("site_id", "parent_path")
                .agg(F.count("*").alias("children")).withColumnRenamed("parent_path", "path"))
    with_id = ordered.withColumn("node_id", _node_id(F.col("depth"), F.col("sibling_idx"), F.col("name")))
    with_id = materialize(with_id.join(families, ["site_id", "path"], "left"), "graph-ids")
    parents = with_id.filter("children is not null").select("site_id", F.col("path").alias("parent_path"), F.col("node_id").alias("parent_id"), "children")
    every = with_id.withColumn("is_folder", F.col("children").isNotNull()).drop("children")
    below = join_group_facts(every.filter(F.col("parent_path").isNotNull()), parents, ["site_id", "parent_path"], "children")
    top = every.filter(F.col("parent_path").isNull()).withColumn("parent_id", F.lit("root"))
    return (below.drop("children").unionByName(top)
            .select("site_id", "node_id", "name", "path", "depth", "is_folder", "parent_path", "parent_id", "sibling_idx",
                    F.col("line_no").alias("edge_no")))


def graph_edges(gnodes: DataFrame) -> DataFrame:
    """Parent -> child edges, 'root' above the top level."""
    return gnodes.select("site_id", "edge_no", F.col("parent_id").alias("from_id"),
                         F.col("node_id").alias("to_id"),
                         F.coalesce(F.col("parent_path"), F.lit("root")).alias("from_path"),
                         F.col("path").alias("to_path"))


def first_graph_nodes(urls: DataFrame, k: int | None = GRAPH_MAX_EDGES, max_depth: int | None = GRAPH_MAX_DEPTH) -> DataFrame:
    """T6 for the first ``k`` nodes per site in traversal order.

    The cut is a limit per site, applied before its shuffle, too.  The
    earlier siblings of a node are among the first ``k`` with it, so
    ``sibling_idx`` is the whole one.
    """
    if k is None:
        return graph_nodes(urls, max_depth)
    nodes = materialize(tree_nodes(urls, None if max_depth is None else max_depth + 1), "graph-nodes")
    drawn = nodes if max_depth is None else nodes.filter(F.col("depth") <= max_depth)
    ordered = _node_columns(_keyed(drawn).withColumn("line_no", F.row_number().over(Window.partitionBy("site_id").orderBy("key")))
                            .filter(F.col("line_no") <= k), "line_no")
    ordered = materialize(ordered.withColumn("sibling_idx", F.row_number().over(
        Window.partitionBy("site_id", "parent_path").orderBy("first_seen")) - 1), "graph-first")
    return _graph(nodes.join(ordered.select("site_id", F.col("path").alias("parent_path")), ["site_id", "parent_path"], "left_semi"),
                  ordered)


def graph_edges_top(urls: DataFrame, k: int | None = GRAPH_MAX_EDGES, max_depth: int | None = GRAPH_MAX_DEPTH) -> DataFrame:
    """The first ``k`` edges per site in traversal order; None: no limit."""
    return graph_edges(first_graph_nodes(urls, k, max_depth))

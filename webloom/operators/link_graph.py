"""The internal link graph: nodes by key, edges resolved by join, degrees, and the lists built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import graph_key_of
from webloom.operators.audits import by_depth_and_url, title_of  # noqa: F401
from webloom.plans.prefix import global_rank
from webloom.plans.tables import Stash


@dataclass
class LinkGraph:
    """nodes(key, ord, url, depth, title, in_links, out_links); edges(source, target, ...); broken(source, href, ...)."""

    nodes: DataFrame
    edges: DataFrame
    broken: DataFrame

    def totals(self) -> DataFrame:
        links = self.edges.agg(F.count("*").alias("total_internal_links"))
        return self.nodes.agg(F.count("*").alias("page_count")).crossJoin(links)  # one row by one row


def graph_of(nodes: DataFrame, links: DataFrame) -> LinkGraph:
    """Resolves links (source, target, ...) between keys of ``nodes`` (key, ord, ...) and counts degrees.

    Links to keys that no node has are broken. Self-links and parallel links count. Both joins are plain
    equi-joins on the key, so a hub splits where Spark finds its partition skewed.
    """
    keys = nodes.select(F.col("key").alias("target"))
    edges = links.join(keys, "target", "left_semi")
    broken = links.join(keys, "target", "left_anti")
    into = edges.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("in_links"))
    out = edges.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("out_links"))
    none = F.lit(0).cast("long")
    counted = nodes.join(into, "key", "left").join(out, "key", "left").withColumn("in_links", F.coalesce("in_links", none)).withColumn("out_links", F.coalesce("out_links", none))
    return LinkGraph(counted, edges, broken)


def link_graph(snapshot: DataFrame) -> LinkGraph:
    """The graph of a snapshot's pages that are no duplicates.

    Of pages with the same key the last record counts, in the place of the first; all their links attach. Pages and
    links are read once, with their keys, into a written table of links (a page without links has one empty row). A
    snapshot without the ``seo`` record has empty titles.
    """
    pages = snapshot.where("not is_duplicate").select("ord", "url", "depth", title_of(snapshot), F.posexplode_outer("links.internal").alias("pos", "link"))
    keyed = pages.select("ord", "url", "depth", "title", "pos", "link.href", "link.anchor", graph_key_of("url").alias("source"), graph_key_of("link.href").alias("target"))
    rows = Stash(snapshot.sparkSession, "link-graph").put(keyed, "links")
    page = F.struct("ord", "url", "depth", "title")
    nodes = rows.where("coalesce(pos, 0) = 0").groupBy(F.col("source").alias("key")).agg(F.min("ord").alias("first"), F.max(page).alias("last"))
    nodes = nodes.select("key", F.col("first").alias("ord"), "last.url", "last.depth", "last.title")
    return graph_of(nodes, rows.where("pos is not null").select("source", "target", "ord", "pos", "url", "href", "anchor"))


def orphans(graph: LinkGraph, seed_key: str | int) -> DataFrame:
    return graph.nodes.where((F.col("in_links") == 0) & (F.col("key") != F.lit(seed_key)))


def sinks(graph: LinkGraph) -> DataFrame:
    return graph.nodes.where("out_links = 0")


def single_path(graph: LinkGraph) -> DataFrame:
    """Pages with one link in, with its source and anchor."""
    lone = graph.nodes.where("in_links = 1").withColumnRenamed("key", "target")
    first = graph.edges.groupBy("target").agg(F.min_by(F.struct(F.col("url").alias("linked_from"), "anchor"), F.struct("ord", "pos")).alias("f"))
    return lone.join(first, "target").select(F.col("target").alias("key"), "url", "title", "depth", "f.linked_from", "f.anchor")


def ranked(rows: DataFrame, stash: Stash, by: tuple[str, ...] = ("depth", "url")) -> DataFrame:
    """Adds ``rank``, the place of each row from 0 in the order of ``by``; urls stand as readers sort them."""
    order = [F.asc(F.collate(c, "UNICODE") if c == "url" else c) for c in by]
    return global_rank(stash.put(rows, "rows"), stash, order, "rank")


def top_pages(graph: LinkGraph, by: str = "in_links", limit: int = 25, tie: Column | str = "ord") -> DataFrame:
    return graph.nodes.orderBy(F.desc(by), tie).limit(limit)


def broken_links(graph: LinkGraph) -> DataFrame:
    return graph.broken.select(F.col("url").alias("from"), "href", "anchor", "ord", "pos").orderBy("from", "ord", "pos")

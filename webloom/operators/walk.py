"""Offline breadth-first walk over a page store, body duplicates, redirect chains."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.columns import in_scope_of, seen_key
from webloom.functions.urls import hostname, parse, without_www
from webloom.plans.tables import Stash, bounded, spare

REASONS = ("DUPLICATE_URL", "ERROR", "MAX_DEPTH", "OUT_OF_SCOPE", "REDIRECT", "ROBOTS")


@dataclass(frozen=True)
class WalkConfig:
    """Where to walk; checked when made."""

    seed: str
    max_depth: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    subdomains: bool = False
    respect_robots: bool = True
    max_pages: int | None = None
    domain: str = field(default="")

    def __post_init__(self) -> None:
        url = parse(self.seed)
        if url is None or url.scheme not in ("http", "https"):
            raise ValueError("the seed must be an http or https URL")
        if self.max_depth is not None and self.max_depth < 0:
            raise ValueError("max_depth must not be negative")
        if set(self.include) & set(self.exclude):
            raise ValueError("a pattern is both included and excluded")
        if not self.domain:
            object.__setattr__(self, "domain", without_www(hostname(self.seed) or ""))


@dataclass
class WalkResult:
    """pages(url, depth, status, is_duplicate, ...), ignored(url, depth, reason) and buried(url, depth)."""

    pages: DataFrame
    ignored: DataFrame
    buried: DataFrame

    def summary(self) -> DataFrame:
        """(reason, urls), reasons that occurred only."""
        return self.ignored.groupBy("reason").agg(F.count("*").alias("urls"))


def duplicate_bodies(rows: DataFrame, body: str, order: list[str | Column], out: str = "is_duplicate") -> DataFrame:
    """Marks all but the first row of each body; an empty or null body is never a duplicate.

    The first of each hash comes from a map-side aggregation of hashes and order columns. Only hashes of several
    rows are joined back: broadcast if they are counted as few, so that rows stay where they are; else rows are
    shuffled by their hash, those without a body by one of their own.
    """
    sha, first, n = spare(rows, "sha", "first", "n")
    place = F.struct(*order)
    text = F.when(F.octet_length(body) > 0, F.sha2(F.col(body), 256))
    firsts = rows.select(text.alias(sha), place.alias(first)).where(F.col(sha).isNotNull()).groupBy(sha).agg(F.min(first).alias(first), F.count("*").alias(n))
    firsts = bounded(Stash(rows.sparkSession, "bodies").put(firsts.where(F.col(n) > 1).drop(n), "repeated"))
    keyed = rows.withColumn(sha, F.coalesce(text, F.concat(F.lit("-"), F.xxhash64(*order).cast("string"))))
    return keyed.join(firsts, sha, "left").withColumn(out, F.coalesce(place != F.col(first), F.lit(False))).drop(sha, first)


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int | None, stash: Stash) -> DataFrame:
    """(node, depth): the least number of edges (source, target) from a seed, up to ``max_depth`` if one is given.

    One join per level; levels are written tables, so lineage does not grow. Ends when a level is empty.
    """
    level = stash.put(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    edges = stash.put(edges, "edges")
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        following = level.join(edges, level["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        level = stash.put(following.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def walk(spark: SparkSession, store: DataFrame, config: WalkConfig, robots: DataFrame | None = None) -> WalkResult:
    """Walks ``store``: (url, status, body, location, targets), targets being normal-form links.

    A URL that the store lacks answers 404. Redirects cost no depth and are not captured; status 0 is an
    error. ``robots`` has (url, allowed) and is asked by seen key. Depth is the least one; of equal bodies
    the least (depth, url) is the original, and duplicates' links are not followed.
    """
    stash = Stash(spark, "walk")
    pages = store.withColumn("key", seen_key("url")).dropDuplicates(["key"])
    frontier = spark.createDataFrame([(config.seed,)], "url string").withColumn("key", seen_key("url"))
    seen = captured = ignored = buried = None
    bodies = None
    depth = 0
    add = lambda one, two: two if one is None else one.unionByName(two)
    while True:
        frontier = stash.put(frontier.select("url", "key").dropDuplicates(["key"]), "frontier")
        if frontier.isEmpty():
            break
        if config.max_depth is not None and depth > config.max_depth:
            buried = frontier.select("url", F.lit(depth).alias("depth"))
            ignored = add(ignored, buried.withColumn("reason", F.lit("MAX_DEPTH")))
            break
        hop, seeking = frontier, []
        while True:  # redirects stay on the level of the URL that led to them
            seen = add(seen, hop.select("key"))
            got = hop.join(pages.drop("url"), "key", "left").withColumn("status", F.coalesce("status", F.lit(404)))
            if robots is not None and config.respect_robots:
                got = got.join(robots.select(seen_key("url").alias("key"), "allowed"), "key", "left")
                ignored = add(ignored, stash.put(got.where("not coalesce(allowed, true)").select("url", F.lit(depth).alias("depth"), F.lit("ROBOTS").alias("reason")), "robots"))
                got = got.where("coalesce(allowed, true)").drop("allowed")
            got = stash.put(got, "fetched")
            turned = got.where("status between 300 and 399")
            failed = got.where("status = 0")
            for rows, reason in ((turned, "REDIRECT"), (failed, "ERROR")):
                ignored = add(ignored, rows.select("url", F.lit(depth).alias("depth"), F.lit(reason).alias("reason")))
            seeking.append(got.where("status <> 0 and not (status between 300 and 399)"))
            onward = turned.where("location is not null").select(F.col("location").alias("url")).withColumn("key", seen_key("url"))
            onward = onward.where(in_scope_of("url", config.domain, config.include, config.exclude, config.subdomains)).dropDuplicates(["key"])
            hop = stash.put(onward.join(seen, "key", "left_anti"), "hop")
            if hop.isEmpty():
                break
        level = seeking[0]
        for more in seeking[1:]:
            level = level.unionByName(more)
        level = level.withColumn("depth", F.lit(depth)).withColumn("sha", F.when(F.octet_length("body") > 0, F.sha2(F.col("body"), 256)))
        # empty bodies are no duplicates: they get keys of their own, and meet no other row
        level = stash.put(level.withColumn("body_key", F.coalesce("sha", F.concat(F.lit("-"), F.col("key")))), "level")
        firsts = level.where("sha is not null").groupBy(F.col("sha").alias("body_key")).agg(F.min("url").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
        marked = level.join(firsts, "body_key", "left").withColumn("is_duplicate", F.coalesce(F.col("url") != F.col("first_url"), F.lit(False))).drop("first_url")
        if bodies is not None:
            marked = marked.join(bodies.select(F.col("sha").alias("body_key"), F.lit(True).alias("old")), "body_key", "left")
            marked = marked.withColumn("is_duplicate", F.col("is_duplicate") | F.coalesce("old", F.lit(False))).drop("old")
        level = stash.put(marked.drop("body_key"), "level")
        bodies = add(bodies, level.where("sha is not null and not is_duplicate").select("sha"))
        captured = add(captured, level.select("url", "depth", "status", "is_duplicate", "sha"))
        links = level.where("not is_duplicate").select(F.explode("targets").alias("url")).withColumn("key", seen_key("url")).dropDuplicates(["key"])
        frontier = links.join(seen, "key", "left_anti").where(in_scope_of("url", config.domain, config.include, config.exclude, config.subdomains))
        depth += 1
    none = spark.createDataFrame([], "url string, depth int, reason string")
    pages_out = captured.drop("sha")
    if config.max_pages is not None:
        pages_out = pages_out.orderBy("depth", "url").limit(config.max_pages)
    return WalkResult(pages_out, none if ignored is None else ignored, none.select("url", "depth") if buried is None else buried)


def stop_reason(timed_out: bool, natural: bool) -> str:
    return "time_limit" if timed_out else "drained" if natural else "max_pages"


def resolve_redirects(spark: SparkSession, redirects: DataFrame, starts: DataFrame, hops: int = 10) -> DataFrame:
    """(url, final_url, hops): each start followed over (url, location) for at most so many hops."""
    stash = Stash(spark, "redirects")
    at = starts.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"))
    table = redirects.select(F.col("url").alias("final_url"), "location").dropDuplicates(["final_url"])
    for _ in range(hops):
        at = stash.put(at.join(table, "final_url", "left"), "hop")
        if at.where("location is not null").isEmpty():
            return at.drop("location")
        at = at.select("url", F.coalesce("location", "final_url").alias("final_url"), (F.col("hops") + F.col("location").isNotNull().cast("int")).alias("hops"))
    return at

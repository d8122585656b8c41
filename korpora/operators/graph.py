"""The link graph: edges, counts of links, PageRank and reachability."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions.urls import domain
from korpora.session import materialize

DAMPING, ITERATIONS = 0.85, 20


def resolved_edges(docs: DataFrame) -> DataFrame:
    """(src, dst): distinct links between indexed pages, no page to itself."""
    links = docs.select(F.col("id").alias("src"), F.explode("links").alias("url"))
    return links.join(docs.select("url", F.col("id").alias("dst")), "url").where("src <> dst").select("src", "dst").distinct()


def inlink_counts(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, inlinks) of every page."""
    counted = edges.groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("inlinks"))
    return docs.select(F.col("id").alias("doc_id")).join(counted, "doc_id", "left").select("doc_id", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))


def dangling_nodes(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id) of pages without an outgoing edge."""
    return docs.select(F.col("id").alias("doc_id")).join(edges.select(F.col("src").alias("doc_id")).distinct(), "doc_id", "left_anti")


def pagerank(docs: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, authority): PageRank with the dangling mass spread evenly, divided by its maximum.

    What is spread evenly is the same number for every page, so a round needs
    not know it: the ranks are sums of the vectors that one unit per page
    becomes after each number of steps along the links, and the even parts only
    weight these vectors. A round is thus one join with the links and one sum,
    its vector holds only pages that links reach, and the weights follow at the
    end from the vectors' sums over pages without links. Each round is stored
    in the shared folder, so plans do not grow.
    """
    n = docs.count()
    if not n:
        return docs.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("authority"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("targets"))
    graph = materialize(out, "graph")
    given = (F.lit(damping) / F.size("targets")).alias("share")
    state, vectors = graph.select("targets", given), []
    for _ in range(iterations):
        moved = state.select(F.explode("targets").alias("id"), "share").groupBy("id").agg(F.sum("share").alias("v"))
        vectors.append(materialize(moved, "rank"))
        state = graph.join(vectors[-1], "id").select("targets", (F.col("v") * given).alias("share"))
    steps = [v.select("id", "v", F.lit(j).alias("step")) for j, v in enumerate(vectors, 1)]
    each = functools.reduce(DataFrame.unionByName, steps)
    # One row per round; what reaches pages without links.
    lost = {r["step"]: r["v"] for r in each.join(graph.select("id"), "id", "left_anti").groupBy("step").agg(F.sum("v").alias("v")).collect()}
    dangling = [float(n - graph.count()), *(lost.get(j, 0.0) for j in range(1, iterations + 1))]
    even: list[float] = []  # what every page is given in rounds 1, 2, ...
    for k in range(iterations):
        mass = dangling[k] / n + sum(even[k - 1 - j] * dangling[j] for j in range(k))
        even.append((1 - damping) / n + damping * mass / n)
    weights = [even[iterations - 1 - j] for j in range(iterations)] + [1.0 / n]
    weighted = F.element_at(F.array(*map(F.lit, weights)), F.col("step") + 1) * F.col("v")
    reached = each.select("id", weighted.alias("part")).groupBy("id").agg(F.sum("part").alias("part"))
    rank = docs.select("id").join(reached, "id", "left").select("id", (F.lit(weights[0]) + F.coalesce("part", F.lit(0.0))).alias("rank"))
    top = rank.agg(F.max("rank").alias("top"))
    return rank.join(F.broadcast(top)).select(F.col("id").alias("doc_id"), (F.col("rank") / F.col("top")).alias("authority"))  # one row


def crawl_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(doc_id, depth): pages reached from the seeds, at their first depth, by a frontier that drops what was met before."""
    seen = materialize(seeds.select("doc_id", F.lit(0).alias("depth")).distinct(), "frontier")
    frontier = seen
    for depth in range(1, max_depth + 1):
        ahead = edges.join(frontier.select(F.col("doc_id").alias("src")), "src").select(F.col("dst").alias("doc_id")).distinct()
        frontier = materialize(ahead.join(seen, "doc_id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def _numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Stored rows with ``nth`` from ``start`` in the given order, numbered in parallel: ranges first, places within them after."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    stored = materialize(ranged.withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "crawl")
    sizes = stored.groupBy("_range").count().orderBy("_range").collect()  # one row per partition
    ahead, offsets = start, []
    for r in sizes:
        offsets += [F.lit(r["_range"]), F.lit(ahead)]
        ahead += r["count"]
    nth = F.create_map(*offsets)[F.col("_range")] + F.col("_at") if offsets else F.lit(start)
    return stored.withColumn("nth", nth).drop("_range", "_at")


def crawl_order(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int = 50, max_depth: int = 2, same_domain: bool = True) -> DataFrame:
    """(url, depth, nth, outcome) of what a breadth-first crawl of a stored web fetches, numbered from 0 in its order.

    ``pages`` is (url, outcome) with 'indexed', 'skipped' or 'error' as the
    outcome of a fetch, ``links`` (url, target, at) the links of a page in
    order, ``seeds`` (url, at) the start in order. A page queues those of its
    targets that were not met before, with ``same_domain`` on the hosts of the
    seeds alone; the crawl ends when ``max_pages`` are indexed. What is not
    stored is an error, and errors queue nothing.
    """
    known = pages.select("url", "outcome").dropDuplicates(["url"])
    start = seeds.where("url IS NOT NULL").groupBy("url").agg(F.min("at").cast("long").alias("at"))
    hosts = start.select(domain(F.col("url")).alias("host")).distinct()
    level = start.select("url", F.lit(0).cast("long").alias("parent"), "at")
    levels: list[DataFrame] = []
    fetched = indexed = 0
    for depth in range(max_depth + 1):
        tried = level.join(known, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("error")))
        numbered = _numbered(tried, ["parent", "at", "url"], fetched).select("url", F.lit(depth).alias("depth"), "nth", "outcome")
        left = max_pages - indexed
        last = numbered.where("outcome = 'indexed'").orderBy("nth").limit(left).agg(F.count("*").alias("n"), F.max("nth").alias("nth")).first()
        done = last["n"] >= left
        numbered = numbered.where(F.col("nth") <= (last["nth"] if last["nth"] is not None else -1)) if done else numbered
        levels.append(numbered)
        if done or depth == max_depth:
            break
        indexed, fetched = indexed + last["n"], fetched + numbered.count()
        met = functools.reduce(DataFrame.unionByName, levels).select("url")
        ahead = numbered.where("outcome <> 'error'").select("url", F.col("nth").alias("parent")).join(links, "url").where("target IS NOT NULL")
        first = ahead.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("parent", F.col("at").cast("long").alias("at"))).alias("m"))
        level = first.select("url", "m.parent", "m.at").join(met, "url", "left_anti")
        if same_domain:
            level = level.withColumn("host", domain(F.col("url"))).join(hosts, "host", "left_semi").drop("host")
    return functools.reduce(DataFrame.unionByName, levels)

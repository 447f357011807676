"""Graph operators over edge tables: scans, neighbourhoods, paths, property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import ensure_checkpoint_dir


def both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), *(c for c in links.columns if c not in ("source", "target")))
    return links.unionByName(back.select(*links.columns))


def neighbourhood(links: DataFrame, start: int, depth: int, min_weight: float = 0.3) -> DataFrame:
    """Nodes within depth steps of the start and their least number of steps. Visited nodes are not walked again."""
    edges = both_ways(links.where(F.col("weight") >= min_weight)).select("source", "target").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node long, hops int")
    front = seen
    for hop in range(1, depth + 1):
        reached = edges.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def shortest_path(links: DataFrame, start: int, goal: int, max_depth: int = 5) -> DataFrame:
    """The shortest path as an array of nodes; of equally short ones the least as text (1>10>3 before 1>9>3). One row for each
    reached node is kept per step: paths of a step that end alike stay in that order however they go on."""
    edges = both_ways(links).select("source", "target").distinct()
    paths = edges.sparkSession.createDataFrame([(start, [start])], "node long, path array<long>")
    found = paths
    for _ in range(max_depth):
        step = edges.join(paths.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        paths = step.join(found.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by("path", F.array_join(F.col("path").cast("array<string>"), ">")).alias("path"))
        found = found.unionByName(paths)
    return found.where(F.col("node") == goal)


def link_stats(links: DataFrame, top: int = 10) -> DataFrame:
    """The most connected nodes: each end of a link counts."""
    ends = links.select(F.col("source").alias("node")).unionAll(links.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(top)


def orphans(links: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Links with an end that is no node."""
    ids = nodes.select(F.col(key).alias("_node")).distinct()
    no_source = links.join(ids, links["source"] == ids["_node"], "left_anti")
    no_target = links.join(ids, links["target"] == ids["_node"], "left_anti")
    return no_source.unionByName(no_target).distinct()


def property_graph(episodes: DataFrame, facts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (episodes, facts, topics) and edges (about, source_of, and the links)."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nodes = (
        episodes.select(name("episode", "id").alias("node"), F.lit("episode").alias("kind"))
        .unionAll(facts.select(name("fact", "id"), F.lit("fact")))
        .unionAll(episodes.select(name("topic", "topic"), F.lit("topic")).distinct())
    )
    edges = (
        episodes.select(name("episode", "id").alias("source"), name("topic", "topic").alias("target"), F.lit("about").alias("kind"))
        .unionAll(facts.join(episodes.select(F.col("id").alias("_e")), F.col("source_episode") == F.col("_e"), "left_semi").select(name("episode", "source_episode"), name("fact", "id"), F.lit("source_of")))
        .unionAll(links.select(name("episode", "source"), name("episode", "target"), F.col("kind")))
    )
    return nodes, edges


def chains(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Least node that each node of the links reaches. Each round takes the least label of a node's neighbours and then that
    label's own label, so the rounds grow with the logarithm of the longest path; it ends when no label changes."""
    ensure_checkpoint_dir(spark)
    edges = both_ways(links).select("source", "target").distinct().checkpoint()
    labels = edges.select(F.col("source").alias("node")).distinct().withColumn("chain", F.col("node"))
    before = None
    while True:
        spread = edges.join(labels.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("chain").alias("_near"))
        near = labels.join(spread, "node", "left").select("node", F.least("chain", F.coalesce("_near", "chain")).alias("chain"))
        pointed = near.select(F.col("node").alias("chain"), F.col("chain").alias("_far"))
        labels = near.join(pointed, "chain", "left").select("node", F.least("chain", F.coalesce("_far", "chain")).alias("chain")).checkpoint()
        now = labels.agg(F.sum(F.col("chain").cast("decimal(38,0)"))).first()[0]  # labels only ever fall
        if now == before:
            return labels
        before = now

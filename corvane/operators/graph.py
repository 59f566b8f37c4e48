"""Object graph: extraction, resolution, traversal, components, ranking.

Traversals are level by level: a frontier joins the edges on its key, what was
seen before is removed by an anti join, and every level is written to the
shared folder, which cuts the lineage. Nothing is collected but counts.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.sources.tables import checkpointed

LINK = r"\[\[([^\[\]|#\n]+)(#[^\[\]|\n]*)?(\|[^\[\]\n]*)?\]\]"
TAG = r"(?:^|[^0-9A-Za-z_#&/])#([A-Za-z][0-9A-Za-z_-]*)"
CODE = r"(?s)```.*?```|`[^`\n]+`"


def without_code(text: Column) -> Column:
    return F.regexp_replace(text, CODE, " ")


def label_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def meaningful_tag(c: Column) -> Column:
    """Not only digits, and no hexadecimal colour of 3, 4, 6 or 8 digits."""
    return ~c.rlike(r"^[0-9]+$") & ~c.rlike(r"^(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$")


def links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, target): link targets outside code, in order."""
    found = F.regexp_extract_all(without_code(F.col(text)), F.lit(LINK), F.lit(1))
    return docs.filter(F.col(text).contains("[[")).select(F.col(key).alias("key"), F.posexplode(found).alias("ordinal", "t")).select(
        "key", "ordinal", label_key(F.col("t")).alias("target"))


def tags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag): each tag of a text once."""
    found = F.regexp_extract_all(without_code(F.col(text)), F.lit(TAG), F.lit(1))
    t = docs.filter(F.col(text).contains("#")).select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(found, F.lower))).alias("tag"))
    return t.filter(meaningful_tag(F.col("tag")))


def resolve(found: DataFrame, docs: DataFrame, key: str, title: str) -> DataFrame:
    """(key, ordinal, target, doc): the one document whose title is the target; two of one title bind to neither."""
    names = docs.select(label_key(F.col(title)).alias("target"), F.col(key).alias("doc")).filter(F.col("target") != "")
    only = names.groupBy("target").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).filter("n = 1").drop("n")
    return found.join(only, "target", "left")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, node_cap: int | None = None) -> DataFrame:
    """(node, depth): least depth of every node within ``depth`` steps of the seeds (node); without a depth, of every node they reach.

    ``node_cap`` is the feature of a bounded view: levels are cut in node order once that many nodes are found.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in count(1) if depth is None else range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        if node_cap is not None:
            left = node_cap - seen.count()
            if left <= 0:
                break
            new = new.orderBy("node").limit(left)
        new = checkpointed(new)  # else every level would compute the ones before it again
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def simple_paths(edges: DataFrame, start, depth: int) -> DataFrame:
    """(path): simple paths from a node of 1 to ``depth`` steps, for the bounded depths of a trace."""
    spark = edges.sparkSession
    paths = spark.range(1).select(F.array(F.lit(start).cast(edges.schema["src"].dataType)).alias("path"))
    out = None
    for _ in range(depth):
        paths = paths.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst").distinct(), "src").filter(
            ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = paths if out is None else out.unionByName(paths)
    return out


def components(edges: DataFrame, rounds: int = 1_000) -> DataFrame:
    """(node, component): smallest node of each node's component, by alternating large-star and small-star.

    A hub's neighbours are linked to the hub's least neighbour, never to each other, so a hot
    node costs its degree. It goes on until nothing changes; ``rounds`` without that are an error.
    """
    e = checkpointed(undirected(edges).filter("src <> dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    before = None
    for _ in range(rounds):
        # large star: larger neighbours go to the least node around
        both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src <> dst").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("a"), F.col("m"), "src")
        e = small.filter("a <> m").select(F.col("a").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))).distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.groupBy("src").agg(F.min("dst").alias("component"))
    return nodes.join(roots.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 24, every: int = 6) -> DataFrame:
    """(node, rank): ranks of a weighted-equal graph; the mass of nodes without out-edges is shared by all."""
    e = checkpointed(edges.select("src", "dst").distinct())
    nodes = checkpointed(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    links = checkpointed(e.join(out, "src"))
    dead = nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti")
    rank = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    for i in range(rounds):
        lost = rank.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        rank = nodes.join(given, "node", "left").join(F.broadcast(lost)).select(  # one row
            "node", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (i + 1) % every == 0:
            rank = checkpointed(rank)
    return rank


def topological(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, level): Kahn's levels, dependencies first; members and dependents of a cycle have none. ``rounds`` levels that don't suffice are an error."""
    left = checkpointed(edges.select("src", "dst").distinct())
    todo = checkpointed(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    out = None
    for level in count():
        free = checkpointed(todo.join(left.select(F.col("src").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            break
        if level == rounds:
            raise RuntimeError(f"more than {rounds} levels")
        found = free.withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        todo = checkpointed(todo.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.select(F.col("node").alias("dst")), "dst", "left_anti"))
    rest = todo.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def ranked_occurrences(found: DataFrame) -> DataFrame:
    """0-based occurrence of each target within its text."""
    w = W.partitionBy("key", "target").orderBy("ordinal")
    return found.withColumn("occurrence", F.row_number().over(w) - 1)

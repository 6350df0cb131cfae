"""Connected components of a table of links.

Links stay distributed. A table of at most ``TASK_LINKS`` links is the work of one
task (union-find). A larger one is first contracted: each task replaces the links
of its part by a forest of stars, and alternating large and small stars point
every node at the smallest it can see, until the table is small enough or no
longer changes. A hub's links are spread over its neighbours by these joins, and
never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import stored

TASK_LINKS = 1_000_000


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (a, b) of a part to stars: each node and the smallest of its component in this part."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = np.array([*root], np.int64)
    yield pd.DataFrame({"a": nodes, "b": np.array([top(x) for x in nodes.tolist()], np.int64)})


def stars(edges: DataFrame) -> DataFrame:
    """One large and one small star step over links (a > b)."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    large = both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("m").alias("b")).distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(smallest.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``links`` (a, b: longs, not null) to (node, component): the smallest node
    of each component, for every node that has a link."""
    shape = "a bigint, b bigint"
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while (n := edges.count()) > task_links:
        after = stored(stars(edges.mapInPandas(forest, shape).where("a != b")), "links")
        settled = after.count() == n and not after.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if settled:  # every node has one link, to the smallest of its component
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    return stored(edges.coalesce(1).mapInPandas(forest, shape), "components").select(F.col("a").alias("node"), F.col("b").alias("component"))

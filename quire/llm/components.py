"""Connected components by alternating large and small stars, in joins and sums over links only; few links are
settled in one task, in arrays of bounded size, as rounds of joins cost more than they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, mapped

#: Links that one task settles: its arrays take about 150 bytes for each.
ONE_TASK = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the least node that each reaches."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        own, other = label[x], label[y]
        apart = own != other
        if not apart.any():
            return nodes, nodes[label]
        x, y, own, other = x[apart], y[apart], own[apart], other[apart]
        # the greater of two least nodes goes under the lesser, then all go under the last that is reached so
        np.minimum.at(label, np.maximum(own, other), np.minimum(own, other))
        while ((up := label[label]) != label).any():
            label = up


def _settled_at_once(batches):
    links = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if links:
        nodes, least = least_reached(*(np.concatenate(side) for side in zip(*links, strict=True)))
        for first in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[first : first + 100_000]) for x in (nodes, least)], ["node", "least"])


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, least): the least node that each linked node reaches, from links (a, b), both long. Checkpoints each round."""
    links = cut(links.filter("a <> b").select("a", "b"))
    if links.count() <= ONE_TASK:
        return cut(mapped(links.coalesce(1), _settled_at_once, "node long, least long"))
    mark = None
    for _ in range(most_rounds):
        links = cut(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
        mark = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")

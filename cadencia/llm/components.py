"""Connected components of a link table, by union-find in parts and star steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _forest(batches):
    """Union-find over the links of one partition: as many links as needed to join them."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(up)]
    found = [(x, r) for x, r in found if x != r]
    for i in range(0, len(found), 50_000):
        yield pd.DataFrame(found[i : i + 50_000], columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a long, b long); root is the smallest reachable.

    Links and labels stay distributed; a node's neighbours are never gathered,
    only their minimum. Each round is cut in the shared checkpoint folder.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut_lineage(e.mapInPandas(_forest, "a long, b long").distinct())
    seen = None
    while True:
        # large star: every neighbour above a node goes to the smallest one around it
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        big = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        near = big.join(low, big["a"] == low["u"])
        e = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m").toDF("a", "b"))
        e = cut_lineage(e.where("a <> b").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())

"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.session import materialise

MAX_ROUNDS = 60
CHUNK_LINKS = 200_000


def _contract(batches):
    """u, v: each node of a chunk of links with the least node it reaches inside the chunk."""
    rows: list[pa.RecordBatch] = []

    def stars():
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in rows:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        rows.append(batch)
        if sum(map(len, rows)) >= CHUNK_LINKS:
            yield stars()
            rows = []
    if rows:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for columns a, b of longs.

    Links are first contracted to stars in chunks of bounded size, as they lie
    in the table. Then alternating large-star and small-star rounds join the
    stars: each keeps the components and shortens the paths, so the number of
    rounds grows with the logarithm of the longest path. Every round is a
    written table; only its row count and checksum come to the driver.
    """
    found = links.select("a", "b").filter("a <> b")
    edges = materialise(found.mapInArrow(_contract, "u bigint, v bigint").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(star, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(star.select("u", "m"))
        seen = Observation()
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        edges = materialise(small.distinct().observe(seen, F.count("*").alias("n"), total))
        state = tuple(seen.get.values())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

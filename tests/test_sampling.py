import hashlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.functions.draws import standard_normal, uniform
from ledgerloom.operators.sampling import cumulative_weights, weighted_pick

WEIGHTS = {"N": {"a": 500, "b": 1, "c": 30, "d": 2}, "S": {"e": 1}, "W": {f"v{i}": 1 + i % 3 for i in range(300)}}


def _dist(spark, names=None):
    rows = [(p, v, n) for p, values in WEIGHTS.items() for v, n in values.items() if names is None or p in names]
    return spark.createDataFrame(rows, "parent string, value string, n bigint")


def _u(stream, row_id):
    return (int(hashlib.md5(f"{stream}|{row_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def test_uniform_is_plain_md5(spark):
    got = spark.range(50).select("id", uniform("s", "id").alias("u")).collect()
    assert all(r.u == _u("s", r.id) for r in got)


def test_normal_moments(spark):
    row = spark.range(20_000).select(standard_normal("z", "id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_weights_tile_the_axis(spark):
    rows = cumulative_weights(_dist(spark), ["value"], ["parent"]).collect()
    for parent, values in WEIGHTS.items():
        mine = sorted((r.lo, r.hi) for r in rows if r.parent == parent)
        assert mine[0][0] == 0 and mine[-1][1] == sum(values.values()) == next(r.total for r in rows if r.parent == parent)
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:]))


def test_pick_equals_brute_force(spark):
    dist = cumulative_weights(_dist(spark), ["value"], ["parent"])
    ranges = {(r.parent, r.value): (r.lo, r.hi, r.total) for r in dist.collect()}
    draws = spark.range(3000).select(
        F.col("id").alias("order_id"), F.element_at(F.array(*map(F.lit, ["N", "S", "W", "?"])), (F.col("id") % 4 + 1).cast("int")).alias("parent")
    )
    got = weighted_pick(draws, dist, "t", ["value"], ["parent"]).collect()
    assert len(got) == 3000
    for r in got:
        if r.parent == "?":
            assert r.value is None
            continue
        low, high, total = ranges[r.parent, r.value]
        assert low <= int(_u("t", r.order_id) * total) < high


def test_pick_without_parent_follows_the_weights(spark):
    dist = cumulative_weights(_dist(spark, ["N"]).drop("parent"), ["value"])
    draws = spark.range(20_000).withColumnRenamed("id", "order_id")
    picked = weighted_pick(draws, dist, "x", ["value"])
    counts = Counter(r.value for r in picked.collect())
    assert sum(counts.values()) == 20_000 and abs(counts["a"] / 20_000 - 500 / 533) < 0.01
    again = weighted_pick(draws.repartition(17), dist, "x", ["value"])
    assert picked.exceptAll(again).count() == 0

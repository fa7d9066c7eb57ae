"""The ordered primitives against plain windows, with one group holding most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions import ordered
from fleetlens.functions.ordered import (
    clamped_totals, first_k_in_group, join_counted, previous_in_group, rank_in_group)
from fleetlens.session import durable


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows and more in group 0, one group null; ids unique."""
    df = spark.range(20000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 101 == 0, F.lit(None))
        .otherwise(F.col("id") % 7).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(50))).alias("o"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, 1).otherwise(-1).alias("d"))
    return df.repartition(6)


def win():
    return W.partitionBy("g").orderBy("o", "id")


def order():
    return [F.col("o").asc(), F.col("id").asc()]


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)




def test_rank(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    same(rank_in_group(skewed, ["g"], order()), skewed.withColumn("rank", F.row_number().over(win())))


def test_hot_group_is_spread(spark, skewed):
    from fleetlens.functions.ordered import SEG, order_segments
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = order_segments(skewed, ["g"], order())
        assert laid.filter("g = 0").select(SEG).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit, hot", [(0, 0), (100_000, 0), (0, 5000), (100_000, 10**9)])
def test_over_several_partitions(spark, skewed, monkeypatch, limit, hot):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(rank_in_group(skewed, ["g"], order()), skewed.withColumn("rank", F.row_number().over(win())))
        same(previous_in_group(skewed, ["g"], order(), {"before": "id"}),
             skewed.withColumn("before", F.lag("id").over(win())))
        back = [F.col("o").desc(), F.col("id").desc()]
        same(previous_in_group(skewed, ["g"], back, {"after": "id"}),
             skewed.withColumn("after", F.lead("id").over(win())))
        s = skewed.withColumn("s", F.sum("d").over(win()))
        want = s.withColumn("t", F.col("s") - F.least(F.lit(0), F.min("s").over(win()))).drop("s")
        same(clamped_totals(skewed, ["g"], order(), {"t": "d"}), want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_without_group(skewed):
    got = rank_in_group(skewed, [], [F.col("id").asc()])
    assert got.filter(F.col("rank") != F.col("id") + 1).count() == 0


@pytest.mark.parametrize("k", [0, 1, 37, 3000])
def test_first_k(skewed, k):
    same(first_k_in_group(skewed, ["g"], order(), k),
         skewed.withColumn("rank", F.row_number().over(win())).filter(F.col("rank") <= k))


@pytest.mark.parametrize("how, limit", [("inner", 0), ("left", 0), ("left", 1000)])
def test_join_counted_deals_hot_keys(skewed, how, limit, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    big = skewed.filter("g is not null")
    small = big.filter("g <> 3").groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_counted(big, small, ["g"], "n", ["id"], how, hot_rows=500)
    same(got.select("id", "g", "top"), big.join(small, "g", how))


def test_order_of_input_does_not_matter(skewed):
    same(rank_in_group(skewed, ["g"], order()), rank_in_group(skewed.repartition(11, "id"), ["g"], order()))


def test_small_groups_are_not_laid_out(skewed, monkeypatch):
    """Only the rows of large groups are written in order."""
    seen = []
    real = ordered.order_segments

    def spy(df, *rest):
        seen.append(df.select("g").distinct().count())
        return real(df, *rest)
    monkeypatch.setattr(ordered, "order_segments", spy)
    monkeypatch.setattr(ordered, "HOT_ROWS", 5000)
    same(rank_in_group(skewed, ["g"], order()), skewed.withColumn("rank", F.row_number().over(win())))
    assert seen == [1]


def test_is_small_counts_bytes(spark, monkeypatch):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.repeat(F.lit("y"), 1000)).alias("a"))
    assert ordered.is_small(df)
    monkeypatch.setattr(ordered, "BROADCAST_BYTES", 150_000)
    assert not ordered.is_small(df) and ordered.is_small(df.select("id", "s"))


@pytest.mark.parametrize("value", ["o", "one", "wide", "void"])
@pytest.mark.parametrize("small", [0, 100_000])
def test_cut_and_first_rows(skewed, monkeypatch, value, small):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", small)
    df = skewed.withColumns({
        "one": F.lit(1), "wide": F.when(F.col("id") % 10 == 0, F.xxhash64("id")).otherwise(F.col("id") % 3),
        "void": F.when(F.col("id") % 3 == 0, F.col("id"))}).withColumn("n", F.coalesce(F.col("g"), F.lit(3)) * 700 + 17)
    order = [F.col(value).desc_nulls_last(), F.col("id").asc()]
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order)).cast("long")).filter("rank <= n")
    same(ordered.first_in_group(df, ["g"], F.col(value), order, "n"), want)
    cut = ordered.cut_in_group(df, ["g"], F.col(value), "n")
    sure = cut.groupBy("g").agg(F.count_if(F.col("_side") == ordered.SURE).alias("sure"), F.max("_left").alias("left"),
                                F.count_if(F.col("_side") == ordered.OPEN).alias("open"), F.first("n").alias("n"), F.count("*").alias("all"))
    for r in sure.collect():
        assert r.sure + (r.left if r.open else 0) == min(r.n, r.all) and (r.open == 0 or r.open > r.left)
    if value == "wide":
        assert cut.filter(F.col("_side") == ordered.OPEN).count() < 5000


def test_join_one(skewed, monkeypatch):
    big = skewed.filter("g is not null")
    one = big.filter("g <> 3").groupBy("g").agg(F.max("id").alias("top"))
    for small, hot in ((100_000, 10), (0, 10), (0, 10**9)):
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", small)
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        for how in ("inner", "left"):
            same(ordered.join_one(big, one, ["g"], ["id"], how).select("id", "g", "top"), big.join(one, "g", how))


def test_join_one_deals_a_hot_key(spark, skewed, monkeypatch):
    """Rows of the hot key reach many join partitions."""
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordered, "HOT_ROWS", 500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        big = skewed.filter("g is not null")
        got = ordered.join_one(big, big.groupBy("g").agg(F.max("id").alias("top")), ["g"], ["id"])
        sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert got.count() == big.count() and len(sizes) > 8 and max(r["count"] for r in sizes) < 5000
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_what_was_counted_as_large_is_not_broadcast(skewed, monkeypatch):
    """Spark holds these written tables for small, but only the count decides."""
    big = durable(skewed.filter("g is not null"))
    one = durable(big.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    joins = [lambda: ordered.join_one(big, one, ["g"], ["id"], "left", written=True),
             lambda: join_counted(big, one, ["g"], "n", ["id"], "left"),
             lambda: ordered.attach(big, one, ["g"]), lambda: join_counted(big, one, ["g"], "n", ["id"], hot_rows=500)]
    small = [j() for j in joins]
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    for was, now in zip(small, (j() for j in joins)):
        assert "BroadcastHashJoin" in plan_of(was) and "SortMergeJoin" in plan_of(now) and "BroadcastHashJoin" not in plan_of(now)
        same(now, was)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()

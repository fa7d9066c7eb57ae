"""Ranking, neighbours and clamped running totals without one task per group.

``row_number() over (partition by g order by o)`` sends a whole group to one
task, which fails when a group holds a large share of the table. Groups are
therefore counted first: up to ``HOT_ROWS`` rows they go through a plain window.
The rows of larger ones are laid out by range over (group, order), so a big group
is simply spread over many consecutive partitions, and each row gets its position.
What one partition has to know about the ones before it is a small table with one
row per (group, partition). Where only the first rows of a group are asked for,
histograms find a cut value, and nothing behind it is ever sorted.

All functions need ``order`` to be unique within a group, so that results do
not depend on how ties fall.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.session import durable

POS = "_pos"
SEG = "_seg"
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits
HOT_ROWS = 2_000_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
BUCKETS = 1024   # of a histogram, for each group


def is_small(df: DataFrame) -> bool:
    """Whether a written table is known to be small, in rows and in bytes; counting it is cheap."""
    width = F.lit(16)
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(col), F.lit(0))
        elif "<" in kind:
            width += F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
        else:
            width += F.lit(8)
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that never broadcasts it.

    Spark sizes a written table by the files it came from, which can be far smaller than its rows
    (built strings, compressed columns); a table counted as large would then still go through the driver.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a written table when it is known to be small, else join it by shuffle.

    Deciding before the join starts saves the shuffle of the large side that Spark would
    otherwise begin before it knows the small one.
    """
    return F.broadcast(df) if is_small(df) else shuffled(df)


def null_safe(keys: Sequence[str], other: str) -> Column:
    """Equality of the key columns with those called ``other`` + key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return cond


def by_size(df: DataFrame, group: Sequence[str], small: Callable[[DataFrame], DataFrame],
            large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``small`` over the rows of groups of up to ``HOT_ROWS`` rows, ``large`` over those of larger groups.

    There are at most rows / HOT_ROWS large groups, so their list is short.
    """
    if not group:
        return large(df)
    hot = durable(df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select(
        *[F.col(g).alias(f"_h_{g}") for g in group]))
    if hot.isEmpty():
        return small(df)
    same, hot = null_safe(group, "_h_"), F.broadcast(hot)
    return small(df.join(hot, same, "left_anti")).unionByName(large(df.join(hot, same, "left_semi")))


def order_segments(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows laid out by (group, order) with a position and a segment number.

    Runs one job: the layout is checkpointed, see ``session.durable``.
    """
    keys = [F.col(g).asc() for g in group] + list(order)
    laid = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return durable(laid).withColumn(SEG, F.shiftright(F.col(POS), _PARTITION_BITS))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of a written table on null-safe equal keys; the key columns of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(broadcast_if_small(named), null_safe(keys, "_k_")).drop(*[f"_k_{k}" for k in keys])


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  name: str = "rank") -> DataFrame:
    """Exact 1-based position of every row in its group."""
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")
    return by_size(df, group, lambda d: d.withColumn(name, position), lambda d: _rank_laid(d, group, order, name))


def _rank_laid(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    laid = order_segments(df, group, order)
    earlier = W.partitionBy(*group).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    runs = laid.groupBy(*group, SEG).agg(F.count("*").alias("_n"), F.min(POS).alias("_first"))
    # one row per (group, partition): the window below never sees data rows
    base = runs.select(
        *group, SEG,
        (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_base"),
    )
    out = attach(laid, durable(base), [*group, SEG])
    return out.select(*df.columns, (F.col(POS) - F.col("_base") + 1).cast("long").alias(name))


def previous_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                      columns: dict[str, str]) -> DataFrame:
    """Add, for each ``new: old`` in ``columns``, the value of ``old`` in the row before.

    Pass a descending order to look at the row after instead.
    """
    whole = W.partitionBy(*group).orderBy(*order)
    return by_size(df, group, lambda d: d.withColumns({new: F.lag(old).over(whole) for new, old in columns.items()}),
                   lambda d: _previous_laid(d, group, order, columns))


def _previous_laid(df: DataFrame, group: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    laid = order_segments(df, group, order)
    inside = W.partitionBy(*group, SEG).orderBy(POS)
    runs = laid.groupBy(*group, SEG).agg(F.min(POS).alias("_first"), F.max(POS).alias("_last"))
    links = runs.select(
        "_first", F.lag("_last").over(W.partitionBy(*group).orderBy(SEG)).alias("_prev"),
    ).filter(F.col("_prev").isNotNull())
    # a group continues from one partition to the next at most once per partition,
    # so both broadcasts below hold no more rows than there are partitions
    edge = laid.join(F.broadcast(links), F.col(POS) == F.col("_prev")).select(
        F.col("_first"), *[F.col(old).alias(f"_edge_{new}") for new, old in columns.items()])
    local = laid.withColumns({f"_in_{new}": F.lag(old).over(inside) for new, old in columns.items()})
    out = local.join(F.broadcast(edge), F.col(POS) == F.col("_first"), "left")
    return out.select(
        *df.columns,
        *[F.when(F.col("_first").isNotNull(), F.col(f"_edge_{new}"))
          .otherwise(F.col(f"_in_{new}")).alias(new) for new in columns],
    )


def clamped_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   deltas: dict[str, str]) -> DataFrame:
    """Running totals that never go below zero, for each ``total: delta`` column.

    With S the plain running sum, a walk floored at zero that starts at x stands at
    ``S + max(x, max(-S so far))``. A whole run therefore acts on its start value as
    ``max(x + s, m)``, and runs are combined through a window over the small run table.
    """
    return by_size(df, group, lambda d: _totals_plain(d, group, order, deltas), lambda d: _totals_laid(d, group, order, deltas))


def _totals_plain(df: DataFrame, group: Sequence[str], order: Sequence[Column], deltas: dict[str, str]) -> DataFrame:
    upto = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    walk = df.withColumns({f"_s_{t}": F.sum(d).over(upto) for t, d in deltas.items()})
    walk = walk.withColumns({f"_low_{t}": F.max(-F.col(f"_s_{t}")).over(upto) for t in deltas})
    return walk.select(*df.columns, *[
        (F.col(f"_s_{t}") + F.greatest(F.lit(0), f"_low_{t}")).cast("long").alias(t) for t in deltas])


def _totals_laid(df: DataFrame, group: Sequence[str], order: Sequence[Column], deltas: dict[str, str]) -> DataFrame:
    laid = order_segments(df, group, order)
    inside = W.partitionBy(*group, SEG).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    walk = laid.withColumns({f"_s_{t}": F.sum(d).over(inside) for t, d in deltas.items()})
    walk = walk.withColumns({f"_low_{t}": F.max(-F.col(f"_s_{t}")).over(inside) for t in deltas})
    # run ends: total delta and the value reached from a start of "minus infinity"
    runs = walk.groupBy(*group, SEG).agg(
        *[F.max_by(f"_s_{t}", POS).alias(f"_s_{t}") for t in deltas],
        *[F.max_by(F.col(f"_s_{t}") + F.col(f"_low_{t}"), POS).alias(f"_m_{t}") for t in deltas])
    upto = W.partitionBy(*group).orderBy(SEG).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy(SEG)
    runs = runs.withColumns({f"_c_{t}": F.sum(f"_s_{t}").over(upto) for t in deltas})
    runs = runs.withColumns({
        f"_end_{t}": F.col(f"_c_{t}")
        + F.greatest(F.lit(0), F.max(F.col(f"_m_{t}") - F.col(f"_c_{t}")).over(upto))
        for t in deltas})
    starts = runs.select(*group, SEG, *[
        F.coalesce(F.lag(f"_end_{t}").over(before), F.lit(0)).alias(f"_start_{t}") for t in deltas])
    out = attach(walk, durable(starts), [*group, SEG])
    return out.select(
        *df.columns,
        *[(F.col(f"_s_{t}") + F.greatest(f"_start_{t}", f"_low_{t}")).cast("long").alias(t) for t in deltas])


def first_k_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                     name: str = "rank", shares: int = 64) -> DataFrame:
    """The first ``k`` rows of every group, ranked.

    Two cuts: the group is first spread over ``shares`` parts (the literal limit lets
    Spark drop rows before each shuffle), then at most ``k * shares`` rows per group
    meet in the final ranking. Beyond Spark's threshold for such limits the range
    layout is used instead.
    """
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return rank_in_group(df, group, order, name).filter(F.col(name) <= k)
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(shares))
    part = W.partitionBy(*group, "_share").orderBy(*order)
    cut = (
        df.withColumn("_share", spread)
        .withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
        .drop("_r", "_share")
    )
    whole = W.partitionBy(*group).orderBy(*order)
    return (cut.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= k)
            .withColumn(name, F.col(name).cast("long")))


def join_counted(big: DataFrame, small: DataFrame, keys: Sequence[str], rows: str,
                 spread: Sequence[str], how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Join many rows to one row per key when some keys may be very large.

    ``small`` is a written table (see ``session.durable``) and ``small[rows]`` the number
    of ``big`` rows of its key. A small table is broadcast. Without a key above
    ``hot_rows`` this is an ordinary join. Otherwise the rows of hot keys are dealt over as many shares as they need, and the
    small row is copied to each share. There are at most ``total rows / hot_rows`` hot
    keys, which is what makes their list safe to broadcast.
    """
    if is_small(small):
        return big.join(F.broadcast(small), list(keys), how)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    shares = F.ceil(F.col(rows) / F.lit(hot_rows)).cast("int")
    hot = small.filter(F.col(rows) > hot_rows).select(*keys, shares.alias("_shares"))
    if hot.isEmpty():
        return big.join(shuffled(small), list(keys), how)
    dealt = (
        big.join(broadcast_if_small(hot), list(keys), "left")
        .withColumn("_share", F.when(F.col("_shares").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_shares")).cast("int")))
        .drop("_shares")
    )
    copies = small.withColumn("_share", F.explode(
        F.sequence(F.lit(0), F.greatest(shares - 1, F.lit(0)))))
    return dealt.join(shuffled(copies), [*keys, "_share"], how).drop("_share")


def join_one(big: DataFrame, one: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner",
             written: bool = False) -> DataFrame:
    """Join many rows to a table with one row per key, which need not know how many rows each key has.

    ``written`` says that ``one`` is cheap to read again. A small table is broadcast. Otherwise the
    rows of ``big`` are counted per key; those of keys with
    more than ``HOT_ROWS`` are dealt over as many shares as they need by the columns ``spread``, and
    the row of such a key is copied to each share. There are at most rows / HOT_ROWS such keys.
    """
    one = one if written else durable(one)
    if is_small(one):
        return big.join(F.broadcast(one), list(keys), how)
    shares = F.ceil(F.col("_rows") / F.lit(HOT_ROWS)).cast("int").alias("_shares")
    hot = durable(big.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS).select(*keys, shares))
    if hot.isEmpty():
        return big.join(shuffled(one), list(keys), how)
    hot, n = F.broadcast(hot), F.coalesce("_shares", F.lit(1))
    dealt = big.join(hot, list(keys), "left").withColumn("_share", F.pmod(F.xxhash64(*spread), n).cast("int")).drop("_shares")
    copies = one.join(hot, list(keys), "left").withColumn("_share", F.explode(F.sequence(F.lit(0), n - 1))).drop("_shares")
    return dealt.join(shuffled(copies), [*keys, "_share"], how).drop("_share")


SURE, OPEN, OUT = -1, 0, 1


def cut_in_group(df: DataFrame, group: Sequence[str], value: Column, limit: str, rounds: int = 2) -> DataFrame:
    """Which rows are surely among the first ``limit`` of their group by falling ``value``, nulls last.

    Adds ``_side`` (SURE, OPEN or OUT) and ``_left``, how many of the OPEN rows of the group still
    belong to the first. ``value`` is a number and ``limit`` a column with one number per group.
    A histogram of each group has at most ``BUCKETS`` + 1 rows; the bucket in which the limit is
    reached is divided once more, so what stays open is a narrow range of values, or equal ones.
    """
    value = value.cast("double")
    names = [f"_c_{g}" for g in group]
    keyed = lambda d: d.withColumnsRenamed(dict(zip(group, names)))
    out = df.withColumns({"_value": value, "_side": F.lit(OPEN), "_left": F.greatest(F.col(limit), F.lit(0)).cast("long")})
    for _ in range(rounds):
        held = out.filter(F.col("_side") == OPEN)
        span = durable(keyed(held.groupBy(*group).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))))
        joined = out.join(broadcast_if_small(span), null_safe(group, "_c_"), "left").drop(*names)
        width = F.col("_high") - F.col("_low")
        place = F.when(F.col("_value").isNull(), F.lit(BUCKETS)).otherwise(F.least(
            F.floor(F.when(width > 0, (F.col("_high") - F.col("_value")) / width).otherwise(F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)))
        placed = joined.withColumn("_bucket", F.when(F.col("_side") == OPEN, place.cast("int"))).drop("_low", "_high")
        sizes = placed.filter("_bucket is not null").groupBy(*group, "_bucket").agg(F.count("*").alias("_n"), F.first("_left").alias("_want"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # the first bucket that is not wholly in; none if all rows are
        cut = durable(keyed(sizes.withColumn("_before", before).filter(F.col("_before") + F.col("_n") > F.col("_want")).groupBy(*group).agg(
            F.min("_bucket").alias("_cut"), F.min_by(F.col("_want") - F.col("_before"), "_bucket").alias("_rest"))))
        marked = placed.join(broadcast_if_small(cut), null_safe(group, "_c_"), "left").drop(*names)
        at, end = F.col("_bucket"), F.col("_cut")
        side = (F.when(F.col("_side") != OPEN, F.col("_side")).when(end.isNull() | (at < end), F.lit(SURE))
                .when((at > end) | (F.col("_rest") <= 0), F.lit(OUT)).otherwise(F.lit(OPEN)))
        out = marked.withColumns({"_side": side, "_left": F.when(side == OPEN, F.col("_rest"))}).drop(
            "_bucket", "_cut", "_rest")
    return out.drop("_value")


def first_in_group(df: DataFrame, group: Sequence[str], value: Column, order: Sequence[Column], limit: str,
                   name: str = "rank") -> DataFrame:
    """The first rows of every group, ranked, with a limit per group in the column ``limit``.

    ``order`` begins with ``value`` falling and nulls last. Of groups beyond ``HOT_ROWS`` only rows
    that a histogram does not rule out are sorted.
    """
    def large(d: DataFrame) -> DataFrame:
        kept = cut_in_group(d, group, value, limit).filter(F.col("_side") != OUT).drop("_side", "_left")
        return rank_in_group(kept, group, order, name).filter(F.col(name) <= F.col(limit))
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")
    return by_size(df, group, lambda d: d.withColumn(name, position).filter(F.col(name) <= F.col(limit)), large)

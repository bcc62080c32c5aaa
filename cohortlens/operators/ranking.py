"""Exact ranks, prefix sums and medians without putting a whole group into one task.

A plain ``row_number() OVER (PARTITION BY g ORDER BY v)`` sorts every row of ``g`` in one
task, so a group with a third of the data stalls the job. Here an order is split into
buckets that respect it; each bucket is ranked alone and the (small) table of bucket counts
supplies the offset:

* a hash order (``md5`` of seed and key) is uniform, so its leading hex digits are buckets;
* any other order is cut at quantiles of the data, after equal values were counted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import double_array

BUCKETS = 1024
SPREAD = 64
BROADCAST_OFFSETS = 1_000_000  # rows


def hash_order(key: str | Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random order of rows: md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key) if isinstance(key, str) else key).cast("string"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of the joined parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws(":", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_rank(
    df: DataFrame, by: Sequence[str], key: str, seed: int = 42, digits: int = 3,
    groups: int | None = None, rank: str = "rank", total: str = "group_rows",
) -> DataFrame:
    """Add the 0-based position of each row in its group's hash order, and the group's size.

    Equal to ``row_number() OVER (PARTITION BY by ORDER BY md5(seed:key), key) - 1``. The
    window runs inside (group, first hex digits); 16**digits counts per group give offsets.
    Where the caller knows how many ``groups`` there can be, that bounds the offsets, and they
    are broadcast; otherwise they are joined on the window's own partitioning.
    """
    hashed = df.withColumns({"_g": _group(by), "_h": hash_order(key, seed)}).withColumn("_b", F.substring("_h", 1, digits))
    offsets = _offsets(hashed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")), "_b", ["_n"])
    offsets = offsets.select("_g", "_b", "_n_before", F.col("_n_all").alias(total))
    if groups is not None and groups * 16**digits <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_g", "_b").orderBy("_h", key)
    joined = hashed.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["_g", "_b"])
    return joined.withColumn(rank, F.col("_r") + F.col("_n_before")).drop("_g", "_h", "_b", "_r", "_n_before")


def range_cuts(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """At most ``buckets - 1`` quantiles of a column, the only thing that reaches the driver.

    They are taken over all rows, not per group: a bucket then holds about rows / buckets
    rows whatever group they are in, so no (group, bucket) can be larger.
    """
    fractions = double_array(i / buckets for i in range(1, buckets))
    found = df.select(F.percentile_approx(F.col(value).cast("double"), fractions, 10000)).first()[0]
    return sorted(set(found or []))


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Number the range between two cuts that a value falls in."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    numbered = df.withColumn("_v", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep").transform(numbered)
    return cut.withColumn(out, F.col(out).cast("int")).drop("_v")


def prefix_totals(
    groups: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], cuts: Sequence[float],
) -> DataFrame:
    """For rows unique in (by, value): sums of each measure below the value and over the group.

    Adds ``<measure>_before`` (strictly smaller values) and ``<measure>_all``.
    """
    measures = list(measures)
    cut = with_bucket(groups.withColumn("_g", _group(by)), value, cuts)
    inside = Window.partitionBy("_g", "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_{m}_in": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    totals = cut.groupBy("_g", "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    joined = local.join(_offsets(totals, "_bucket", measures).drop(*measures), ["_g", "_bucket"])
    before = {f"{m}_before": F.col(f"{m}_before") + F.col(f"_{m}_in") for m in measures}
    return joined.withColumns(before).drop("_g", "_bucket", *[f"_{m}_in" for m in measures])


def ranks_within(rows: DataFrame, by: Sequence[str], value: str, weight: str, salt: str,
                 cuts: Sequence[float]) -> DataFrame:
    """Add to each row the weight of strictly smaller values in its group, and of the whole group.

    Rows need not be unique in the value: one that is itself a cut may be held by many rows,
    so it has a bucket of its own, spread by a hash of ``salt``; its rows are all peers and
    have nothing below them inside the bucket. Adds ``before`` and ``all``.
    """
    placed = _heavy_apart(rows.withColumn("_g", _group(by)), value, cuts)
    spread = F.pmod(F.xxhash64(salt), F.lit(SPREAD)).cast("int")
    placed = placed.withColumn("_s", F.when(F.col("_heavy"), spread).otherwise(0))
    peers = Window.partitionBy("_g", "_b", "_s").orderBy(value)
    up_to = F.sum(weight).over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum(weight).over(peers.rangeBetween(Window.currentRow, Window.currentRow))
    local = placed.withColumn("_in", F.when(F.col("_heavy"), 0).otherwise(up_to - equal))
    totals = placed.groupBy("_g", "_b", "_heavy").agg(F.sum(weight).alias("_w"))
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    offsets = _offsets(totals, "_b", ["_w"]).select("_g", "_b", F.explode(parts).alias("_s"), "_w_before", "_w_all")
    joined = local.join(offsets, ["_g", "_b", "_s"])
    return joined.withColumns({"before": F.col("_w_before") + F.col("_in"), "all": F.col("_w_all")}).drop(
        "_g", "_b", "_s", "_heavy", "_in", "_w_before", "_w_all")


def _heavy_apart(rows: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Number the ranges in ``_b`` so that a value that is a cut is alone in its bucket (``_heavy``)."""
    numbered = with_bucket(rows, value, cuts, "_b")
    # bucket b starts at cut b - 1, so a value that is a cut equals the start of its bucket
    start = F.try_element_at(double_array(cuts), F.col("_b")) if cuts else F.lit(None)
    heavy = F.when(F.col("_b") > 0, F.coalesce(F.col(value).cast("double") == start, F.lit(False))).otherwise(False)
    numbered = numbered.withColumn("_heavy", heavy)
    return numbered.withColumn("_b", F.col("_b") * 2 + F.when(F.col("_heavy"), 0).otherwise(1))


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median",
                 cuts: Sequence[float] | None = None) -> DataFrame:
    """Exact median per group, found by position among counted values."""
    by = list(by)
    present = df.where(F.col(value).isNotNull())
    cuts = range_cuts(present, value) if cuts is None else cuts
    counted = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_totals(counted, by, value, ["n"], cuts)
    low = F.floor((F.col("n_all") + 1) / 2)
    high = F.floor((F.col("n_all") + 2) / 2)
    covers = lambda pos: (F.col("n_before") < pos) & (pos <= F.col("n_before") + F.col("n"))
    middle = placed.where(covers(low) | covers(high))
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(out))


def order_positions(df: DataFrame, order: str, key: str, seed: int = 42,
                    cuts: Sequence[float] | None = None, position: str = "position") -> DataFrame:
    """Add the 0-based global position in (order, md5(key), key), and ``n_rows``.

    A value that is itself a quantile cut may be held by many rows; it gets a bucket of its
    own that the hash digits split further. Every other bucket lies between two cuts.
    """
    cuts = range_cuts(df, order) if cuts is None else list(cuts)
    placed = _heavy_apart(df, order, cuts).withColumn("_h", hash_order(key, seed))
    placed = placed.withColumn("_s", F.when(F.col("_heavy"), F.substring("_h", 1, 3)).otherwise(F.lit("")))
    counts = placed.groupBy("_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2 * BUCKETS * 4096 rows, whatever the size of df
    running = Window.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b", "_s", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n_rows"),
    )
    inside = Window.partitionBy("_b", "_s").orderBy(order, "_h", key)
    return (
        placed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, ["_b", "_s"])
        .withColumn(position, F.col("_r") + F.col("_before"))
        .drop("_b", "_s", "_h", "_r", "_before", "_heavy")
    )


def _group(by: Sequence[str]) -> Column:
    """The group as one struct: NULL members are ordinary values in it, also in a join."""
    return F.struct(*by) if by else F.struct(F.lit(0))


def _offsets(totals: DataFrame, bucket: str, measures: Sequence[str]) -> DataFrame:
    """Sums over earlier buckets and over all buckets; a group has few buckets, so a window is safe."""
    group = Window.partitionBy("_g")
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({
        **{f"{m}_before": F.coalesce(F.sum(m).over(earlier), F.lit(0)) for m in measures},
        **{f"{m}_all": F.sum(m).over(group) for m in measures},
    })

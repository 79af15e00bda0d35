"""Order and cut large groups without gathering one in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import name
from ..session import settle

# Hex digits of the order hash that name a bucket (65,536 buckets per group).
_BUCKET_DIGITS = 4


def split_at(df: DataFrame, group: str, order_hash: str, limit: str) -> DataFrame:
    """Adds ``first``: true for the ``limit`` rows of each group that come first by hash.

    ``order_hash`` is a column of hex digests; ``limit`` is SQL over ``total``,
    the size of the group. Counting rows per hash prefix finds the one bucket
    where a group is cut; only the rows of that bucket are ranked, so a group
    may be as large as it likes. ``group`` must have few values (class labels).
    """
    carried = [name(c) for c in df.columns]
    bucketed = df.selectExpr(*carried, f"substring({name(order_hash)}, 1, {_BUCKET_DIGITS}) AS _bucket")
    counts = bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_bucket")
    cuts = (counts.withColumn("_upto", F.sum("_n").over(upto))
            .withColumn("total", F.sum("_n").over(Window.partitionBy(group)))
            .withColumn("_limit", F.expr(limit))
            .groupBy(group).agg(
                # First bucket that reaches the limit, and the rows before it.
                F.expr("min(CASE WHEN _upto >= _limit THEN _bucket END)").alias("_edge"),
                F.expr("coalesce(max(CASE WHEN _upto < _limit THEN _upto END), 0)").alias("_before"),
                F.max("_limit").alias("_limit")))
    # One row per label.
    joined = bucketed.join(F.broadcast(cuts), group)
    clear = joined.filter("_edge IS NULL OR _bucket <> _edge").selectExpr(
        *carried, "_edge IS NULL OR _bucket < _edge AS first")
    rank = Window.partitionBy(group, "_bucket").orderBy(order_hash)
    edge = (joined.filter("_bucket = _edge").withColumn("_i", F.row_number().over(rank))
            .selectExpr(*carried, "_before + _i <= _limit AS first"))
    return clear.unionByName(edge)


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group (``rank`` from 1).

    The optimizer cuts every task's rows to ``n`` a group before they are
    shuffled, so a large group sends little more than a small one.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def number_all(df: DataFrame, order: list) -> DataFrame:
    """Number all rows from 1 in a global order (``rank``), sorted in parallel.

    Rows are range-partitioned and written out once; each then adds its place
    in its partition to the rows of the partitions before it.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    fixed = settle(ranged.withColumn("_part", F.shiftright("_at", 33))
                   .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    parts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (fixed.join(F.broadcast(offsets), "_part")
            .selectExpr(*[name(c) for c in df.columns], "_before + _at + 1 AS rank"))


def largest(df: DataFrame, value: str, tie: str, n: int, cells: int = 4096) -> DataFrame:
    """The ``n`` rows of largest ``value`` (a column of whole numbers), ties in the order of ``tie``.

    Rows are counted by ranges of the value, and the range in which the cut falls is
    divided again until it is one value; each time one small aggregate is read. Only rows
    of that one value are put in order, in parallel. Give a table that is stored, as it is scanned a few times.
    """
    low, high, above = 0, (df.agg(F.max(value)).first()[0] or 0) + 1, 0
    if df.count() <= n:
        return df
    while high - low > 1:
        width = -(-(high - low) // cells)
        inside = df.filter((F.col(value) >= low) & (F.col(value) < high))
        counts = inside.groupBy(F.expr(f"({name(value)} - {low}L) div {width}L").alias("cell")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r.cell):
            if above + r.n > n:
                low, high = low + r.cell * width, min(high, low + (r.cell + 1) * width)
                break
            above += r.n
        else:
            return df.filter(F.col(value) >= low)
        if above == n:
            return df.filter(F.col(value) >= high)
    ordered = number_all(df.filter(F.col(value) == low), [F.col(tie)])
    return df.filter(F.col(value) > low).unionByName(ordered.filter(F.col("rank") <= n - above).drop("rank"))

"""Histogram and exact-quantile helpers that never gather a column in one task."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_columns(value: Column, buckets: Sequence[float]) -> list[Column]:
    """Cumulative bucket counts (``le_<bound>`` ... ``le_inf``) as aggregate columns."""
    cols = [F.count(F.when(value <= F.lit(b), 1)).alias(f"le_{_label(b)}") for b in buckets]
    return cols + [F.count(value).alias("le_inf")]


def _label(bound: float) -> str:
    return str(bound).replace(".", "_").removesuffix("_0")


def histogram(df: DataFrame, value: str, buckets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long cumulative histogram: (by..., le, n), one row per bucket; ``le`` NULL is +Inf."""
    wide = df.groupBy(*by).agg(*bucket_columns(F.col(value), buckets))
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{_label(b)}").alias("n")) for b in buckets
    ] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("le_inf").alias("n"))]
    return wide.select(*by, F.inline(F.array(*rows)))


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order: its bits without the sign, negated for negative values.

    Both zeros are 0 and NaN is the largest; NULL stays NULL.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    normal = (power + 1023).cast("long") * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << 52))).cast("long")
    small = (size / F.lit(5e-324)).cast("long")
    bits = (F.when(size == 0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), F.lit(2047 << 52))
            .when(size < F.lit(2.0 ** -1022), small).otherwise(normal))
    return F.when(value.isNull(), F.lit(None).cast("long")).when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: int) -> float:
    """The double that ``ordered_bits`` maps to a number."""
    size = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -size if bits < 0 else size


#: Bits by which each scan narrows the values that a rank may have; a scan brings at most this power of two of counts
#: for each rank to the driver.  A rank that is left with so few rows needs one more scan only.
SELECT_BITS, FEW_ROWS = 16, 1 << 16


def select_ranks(df: DataFrame, value: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, list[float]]:
    """The number of values of a column that are not NULL, and those of the given ranks (from 0) in ascending order.

    ``ranks`` is called with that number.  Each scan counts the values in each of at most 2**16 equal parts of the
    64-bit range that a rank has been narrowed to, so there are four scans at most, and no more as soon as the
    part of a rank has one value or so few rows that each value can be counted.  Nothing is sorted, no task
    gets more than partial counts, and how values are spread or repeat does not matter.
    """
    bits = df.select(ordered_bits(F.col(value).cast("double")).alias("_b")).where(F.col("_b").isNotNull())
    shift, total, open_, found = 64, None, [], {}
    while total is None or open_:
        few = total is not None and sum({part: rows for _, part, _, rows in open_}.values()) <= FEW_ROWS
        before, shift = shift, 0 if few else shift - SELECT_BITS
        rows = bits if total is None else bits.where(F.shiftright("_b", before).isin(*{part for _, part, _, _ in open_}))
        counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("_b", shift)).agg(F.count("*")).collect())
        if total is None:
            total = sum(n for _, n in counts)
            wanted = list(ranks(total)) if total else []
            open_ = [(k, None, rank, total) for k, rank in enumerate(wanted)]
        narrowed = []
        for k, part, rank, _ in open_:
            for here, n in counts:
                if part is not None and here >> (before - shift) != part:
                    continue
                if rank < n:
                    narrowed.append((k, here, rank, n))
                    break
                rank -= n
        open_ = narrowed
        if shift == 0:
            found, open_ = {k: from_ordered_bits(part) for k, part, _, _ in open_}, []
    return total, [found[k] for k in sorted(found)]


def exact_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Exact interpolated percentile of a column as a one-row frame ``(value, n)``; NULL without values.

    The two values between which the percentile lies are found by ``select_ranks``; ``percentile`` would keep
    every distinct value in one task.
    """
    place = lambda n: (n - 1) * p
    n, ends = select_ranks(df, value, lambda n: [math.floor(place(n)), math.ceil(place(n))])
    part = place(n) - math.floor(place(n)) if n else 0.0
    between = None if not n else ends[0] if ends[0] == ends[1] else ends[0] + (ends[1] - ends[0]) * part
    return df.sparkSession.range(1).select(F.lit(between).cast("double").alias(value), F.lit(n).cast("bigint").alias("n"))


def bucketed_lag(df: DataFrame, order: str, bucket: Column, columns: Sequence[str]) -> DataFrame:
    """``lag`` over one global order, without sorting the table in one task.

    Rows are ordered inside ``bucket`` (a coarsening of ``order``, such as its month); the
    first row of a bucket takes its predecessor from the last row of the bucket before.
    Only the one-row-per-bucket frame is ordered as a whole.
    """
    keyed = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy("_bucket").orderBy(order)
    tails = keyed.groupBy("_bucket").agg(
        *[F.max_by(c, order).alias(f"_tail_{c}") for c in columns])
    across = Window.orderBy("_bucket")
    tails = tails.select(
        "_bucket", *[F.lag(f"_tail_{c}").over(across).alias(f"_carry_{c}") for c in columns])
    rows = keyed.withColumn("_first", F.row_number().over(inner) == 1)
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(inner))
    rows = rows.join(tails, "_bucket")
    for c in columns:
        rows = rows.withColumn(
            f"prev_{c}", F.when(F.col("_first"), F.col(f"_carry_{c}")).otherwise(F.col(f"prev_{c}")))
    return rows.drop("_bucket", "_first", *[f"_carry_{c}" for c in columns])

"""Running totals and ranks over orders that no single task could hold.

A window without a partition key, or with a few hot keys, sorts everything in
one task. Here the order is first cut into contiguous buckets. Each bucket is
totalled on its own, the few bucket totals are accumulated, and every row adds
the total of the buckets before it to its own running total inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_OCTAVE = 64
ROWS_EACH = 1_000_000


def order_scale(c: Column) -> Column:
    """A number that never falls as ``c`` rises: each power of two takes one unit, evenly filled.

    It is what the leading bits of a floating-point number say. NaN comes last, as in an ordering.
    """
    size = F.abs(c.cast("double"))
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    place = F.when(size == 0, F.lit(0.0)).when(size == float("inf"), F.lit(2200.0)).otherwise(
        power + size / F.pow(F.lit(2.0), power) + F.lit(1075.0))
    return F.when(F.isnan(size), F.lit(2300.0)).otherwise(F.when(c < 0, -place).otherwise(place))


def ranged(df: DataFrame, by: list[str], column: str, descending: bool = False, per_octave: int = PER_OCTAVE,
           rows_each: int = ROWS_EACH, name: str = "_range") -> DataFrame:
    """Add ``name``: buckets that rise with a number column within ``by``, of about ``rows_each`` rows where values differ.

    Rows are counted in fixed cells, ``per_octave`` for each power of two. A cell that holds more than ``rows_each`` is
    cut into even parts between its own extremes. The cells are counted in one aggregate and joined back; nothing runs
    while the plan is built, and no number of buckets is fixed. Rows of equal value share a bucket: aggregate
    repeated values first. Null values have a bucket of their own, the first in a rising order.
    """
    keys = [*by, "_cell"]
    value = F.col(column)
    celled = df.withColumn("_cell", F.floor(order_scale(value) * per_octave).cast("long"))
    cells = celled.groupBy(*keys).agg(
        F.min(column).alias("_low"), F.max(column).alias("_high"), F.ceil(F.count(F.lit(1)) / rows_each).alias("_parts"))
    right = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_low", "_high", "_parts").where("_parts > 1")
    met = celled.join(right, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    span = lambda x: F.coalesce(F.try_subtract(x, F.col("_low")).cast("double"), x.cast("double") - F.col("_low").cast("double"))
    share = F.try_divide(span(value), span(F.col("_high")))
    part = F.coalesce(F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1), F.lit(0)).cast("long")
    sign = -1 if descending else 1
    return met.select(*df.columns, F.struct((F.col("_cell") * sign).alias("cell"), (part * sign).alias("part")).alias(name))


def hash_bucket(hex_digest: Column, rows: int = 0, rows_each: int = 1_000_000) -> Column:
    """Equal buckets in the order of a hexadecimal digest: 256, or as many times 16 as keep ``rows_each`` rows a bucket."""
    digits = 2
    while 16**digits * rows_each < rows:
        digits += 1
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def running_totals(
    df: DataFrame,
    parts: list[str],
    order: list[Column],
    sums: dict[str, Column],
    bucket: Column,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums by ``order`` within ``parts``.

    ``bucket`` must not fall as the order rises. ``totals`` names extra columns
    that receive the grand total of a sum within its part.
    """
    keys = [*parts, "_bucket"]
    totals = totals or {}
    tagged = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    earlier = W.partitionBy(*[F.col(p) for p in parts]).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*[F.col(p) for p in parts])
    per_bucket = tagged.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    # One leading row per bucket brings in what came before it. It rides along
    # in the shuffle the window needs anyway, so there is no join.
    leading = per_bucket.select(
        *keys, F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_v_{n}") for n in sums],
        *[F.sum(f"_s_{source}").over(whole).alias(f"_t_{name}") for name, source in totals.items()],
    )
    both = tagged.withColumn("_row", F.lit(1)).unionByName(leading, allowMissingColumns=True)
    inside = W.partitionBy(*keys).orderBy("_row", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = both.withColumns({
        **{f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums},
        **{f"_g_{n}": F.first(f"_t_{n}").over(inside) for n in totals},
    })
    named = [*sums, *totals]
    return summed.where("_row = 1").select(
        *[c for c in df.columns if c not in named],
        *[F.col(f"_r_{n}").alias(n) for n in sums], *[F.col(f"_g_{n}").alias(n) for n in totals])

"""First-wins, last-wins and numbering over ordered groups, safe for groups of any size.

``first_row`` and ``last_row`` are aggregates, so each map task sends one row per group and a group
that holds a third of the table costs no more than any other.  ``top_rows`` relies on Spark's
window group limit, which keeps at most k rows per group on the map side.  ``number_sorted`` is for
the cases that need a number on every row: all rows are sorted by group and order into ranges whose
bounds Spark samples, so a large group is spread over many ranges whatever its values are.
``number_rows`` does the same for callers that know even buckets of a group beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityops.session import materialise


def _pick(df: DataFrame, keys: list[str], order: list[Column], smallest: bool) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    choose = F.min_by if smallest else F.max_by
    picked = df.groupBy(*keys).agg(choose(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest order value of each group."""
    return _pick(df, keys, order, smallest=True)


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, smallest=False)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], bucket: list[Column], name: str
) -> DataFrame:
    """Number the rows of each group from 1.

    ``bucket`` must follow ``order``: a row with a smaller bucket comes first.  Choose it so that no
    bucket is large (for example a key divided by a constant).
    """
    marked = df.withColumn("_bucket", F.struct(*bucket))
    counted = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = marked.withColumn("_local", F.row_number().over(inside))
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return numbered.join(offsets, same).select(*df.columns, (F.col("_local") + F.col("_offset")).alias(name))


def number_sorted(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1, in ``order``, which should end with a tie-breaker.

    One range exchange on keys and order deals the rows; rows that agree in both cannot be parted, all others
    can. The sorted ranges are written once, so the range and the place of a row are the same for everyone who
    reads them. What is joined back has one row per group and range: the place of the group's first row there and
    its rows in earlier ranges. Null keys form a group.
    """
    place, first, before = ("_place", "_first", "_before")
    at = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(*at).sortWithinPartitions(*at).withColumn(place, F.monotonically_increasing_id())
    ranged = materialise(ranged)
    part = F.shiftright(place, 33)
    starts = ranged.groupBy(*keys, part.alias("_part")).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), first, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before)
    )
    same = part == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranged.join(starts, same).select(*df.columns, (F.col(place) - F.col(first) + F.col(before) + 1).alias(name))


def number_groups(df: DataFrame, keys: list[str], order: list[Column], name: str, sizes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Number the rows of each group from 1, where rows that are dealt by the keys already stay where they are.

    ``sizes`` has a row for about every row of a group and is cheaper to count than ``df``. Groups above ``most`` of
    its rows are numbered by ``number_sorted``, so that none of them has to pass one task.
    """
    large = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    if large.isEmpty():
        return df.withColumn(name, F.row_number().over(window))
    large = F.broadcast(materialise(large))
    usual = df.join(large, keys, "left_anti").withColumn(name, F.row_number().over(window).cast("long"))
    return usual.unionByName(number_sorted(df.join(large, keys, "left_semi"), keys, order, name))


def join_within(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where only the first one deals the rows; the others are compared within its groups.

    Tables that are dealt by the first key already meet without another exchange, and one sort serves a row of such
    joins. ``right`` should have few rows in each group, as every row of ``left`` is compared with all of them.
    """
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.col(keys[0]) == F.col(f"_k_{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(k) <= F.col(f"_k_{k}")) & (F.col(k) >= F.col(f"_k_{k}"))
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def padded(number: Column, width: int) -> Column:
    """A whole number as text that sorts by its value: zeros in front, and one tilde for every digit past ``width``."""
    text = number.cast("string")
    over = F.length(text) - width
    return F.when(over > 0, F.concat(F.repeat(F.lit("~"), over), text)).otherwise(F.lpad(text, width, "0"))


def order_text(df: DataFrame, name: str, width: int = 12) -> Column:
    """The ordinal column ``name`` as text that sorts like it; text stays as it is."""
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    return padded(F.col(name), width) if whole else F.col(name).cast("string")

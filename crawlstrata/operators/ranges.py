"""Rows in order within a scope, split over tasks however many rows one scope has.

Rows are partitioned by ranges of (scope, order), so a scope with a third of all rows spans many parts, and written with the
number of their part. Within a part, window functions see a scope's rows of that part. What they need from other parts is
carried over by a small table of borders: a scope can only go on in another part if it is the first or the last of its own, so it has
two rows a part at most, which bounds what is broadcast by the number of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crawlstrata.scratch import drop, written

PART = "_part"
#: Rows of a range, about: what a task sorts and holds.
PART_ROWS = 100_000
#: Bits of the map of asked values, and bits of one row of it (as Spark's bitmap functions have it).
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15


def spread(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range of (scope, order). Ranges stand in that order."""
    return written(rows.repartitionByRange(*scope, *order).withColumn(PART, F.spark_partition_id()))


def spread_large(rows: DataFrame, scope: list[str], order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The same, with as many ranges as the rows fill, so that a range doesn't grow with the table.

    Rows are written first: dealing by range reads them twice, and they may be dear to compute.
    """
    flat = written(rows)
    n = max(-(-flat.count() // part_rows), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = written(flat.repartitionByRange(n, *scope, *order).withColumn(PART, F.spark_partition_id()))
    drop(flat)
    parts.ranges = n
    return parts


def dealt(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of ``spread_large`` for windows ``within`` a scope: as many tasks as ranges."""
    return parts.repartition(parts.ranges, PART, *scope)


def within(scope: list[str]) -> WindowSpec:
    """Rows of a scope in one part."""
    return Window.partitionBy(PART, *scope)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def borders(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Columns _part and scope: each scope that spans several parts, with all its parts."""
    whole = F.struct(*scope)
    ends = parts.groupBy(PART).agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
    each = ends.select(PART, F.explode(F.array_distinct(F.array("a", "b"))).alias("s"))
    several = each.groupBy("s").agg(F.collect_set(PART).alias("parts")).where(F.size("parts") > 1)
    return several.select(F.explode("parts").alias(PART), *[F.col(f"s.{c}").alias(c) for c in scope])


def carried(parts: DataFrame, scope: list[str], what: dict[str, Column], carry: dict[str, tuple[str, str]]) -> DataFrame:
    """For each (_part, scope) that spans parts: aggregates ``what`` of its rows, and of other parts' aggregates what ``carry`` names.

    carry: new column -> (aggregate, direction): ``last`` or ``first`` of the parts before or after that is not null, or ``sum`` of those before.
    """
    edge = written(borders(parts, scope))
    mine = parts.join(F.broadcast(edge), same(parts, edge, [PART, *scope]), "left_semi").groupBy(PART, *scope).agg(*[c.alias(k) for k, c in what.items()])
    order = Window.partitionBy(*scope).orderBy(PART)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    make = {"last": lambda c: F.last(c, ignorenulls=True).over(before), "first": lambda c: F.first(c, ignorenulls=True).over(after), "sum": lambda c: F.sum(c).over(before)}
    return mine.select(PART, *scope, *[make[how](c).alias(k) for k, (c, how) in carry.items()])


def with_carried(rows: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """Rows (with _part) and the carried columns of their scope, null where it does not span parts."""
    extra = [c for c in found.columns if c not in (PART, *scope)]
    return rows.join(F.broadcast(found), same(rows, found, [PART, *scope]), "left").select(*[rows[c] for c in rows.columns], *[found[c] for c in extra])


def asked_only(rows: DataFrame, asked: DataFrame, columns: list[str], asked_columns: list[str] | None = None, bits: int = MAP_BITS) -> DataFrame:
    """Rows whose values may be among the asked ones: none that is asked for is lost, and few others stay.

    The asked values set bits of a map (one hash function) that every task tests; it has ``bits`` bits at most, however many are asked, so it is
    broadcast without a check of its size. Fewer bits than asked values only let more rows pass.
    """
    of = lambda names: F.pmod(F.xxhash64(*names), F.lit(bits))
    place = F.col("_place")
    found = asked.select(of(asked_columns or columns).alias("_place")).groupBy(F.floor(place / ROW_BITS).alias("_row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("_bits"))
    at = rows.withColumn("_place", of(columns)).withColumn("_row", F.floor(place / ROW_BITS))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.join(F.broadcast(found), "_row").where(F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1).select(*rows.columns)

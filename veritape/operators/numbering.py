"""Dense numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritape.session import cut

_LOW = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the row in it below


def dense_numbers(rows: DataFrame, order: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``name``: start + 1, start + 2, ... in ``order``, which should be total.

    Rows are dealt to ranges of ``order`` and sorted within them; a range's numbers follow the sizes of those before it. Only
    these sizes, one row for each range, meet in one task. ``start`` may be a column of ``rows``. An empty table stays empty.
    """
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = held.withColumn("__range", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit(_LOW)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    first = F.lit(start) if isinstance(start, int) else start
    numbered = placed.join(F.broadcast(sizes), "__range").withColumn(name, (first + F.col("__before") + F.col("__row") + 1).cast("long"))
    return numbered.drop("__at", "__range", "__row", "__before")

"""Running sums over a whole table, or over groups of any size, without putting either in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

BLOCK = 1 << 16


def running_sum(rows: DataFrame, order: str, amount: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of `amount` over all rows before, in order of a whole-numbered column. Blocks of that column are
    summed, the sums of blocks are run over (a row for each block), and each block runs on its own."""
    rows = rows.withColumn("__amount", amount).withColumn("__block", F.floor(F.col(order) / block))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__block").agg(F.sum("__amount").alias("__total"))
    super_block = F.floor(F.col("__block") / block)  # one task for each 65536 blocks
    totals = totals.withColumn("__super", super_block)
    supers = totals.groupBy("__super").agg(F.sum("__total").alias("__t")).select("__super", F.coalesce(F.sum("__t").over(before.orderBy("__super")), F.lit(0)).alias("__above"))
    bases = totals.join(F.broadcast(supers), "__super").select("__block", (F.col("__above") + F.coalesce(F.sum("__total").over(Window.partitionBy("__super").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__base"))
    inner = F.coalesce(F.sum("__amount").over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(bases, "__block").withColumn(name, (F.col("__base") + inner).cast("bigint")).drop("__block", "__amount", "__base")


def ordered_sums(rows: DataFrame, by: list[str], order: str, **amounts: Column) -> DataFrame:
    """rows with, for each amount, its sum over the rows before in the same group, in order of a column of any kind. Rows are
    dealt to ranges of (by, order) and written with their range's number; ranges are summed, the sums run over (a row for
    each range and group), and each range runs on its own."""
    sizes = {f"__{k}": v for k, v in amounts.items()}
    dealt = rows.repartitionByRange(*by, order).withColumns({**sizes, "__range": F.spark_partition_id()})
    dealt = written(dealt, "ranges")
    above = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(k).alias(k) for k in sizes))
    names = {c: f"__of_{c}" for c in [*by, "__range"]}
    bases = totals.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"__base{k}") for k in sizes))
    joined = dealt.join(bases, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    inner = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*rows.columns, *((F.col(f"__base{k}") + F.coalesce(F.sum(k).over(inner), F.lit(0))).cast("long").alias(k[2:]) for k in sizes))

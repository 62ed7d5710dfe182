"""Total orders. All topology compares (value, offset), where the offset, by default the id, breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled


def cleaned(value: str | Column) -> Column:
    """Null and NaN count as 0, as the tree operators take them."""
    c = F.col(value) if isinstance(value, str) else value
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def dense_index(df: DataFrame, by: list[Column | str], name: str = "index", start: int = 0) -> DataFrame:
    """Adds the 0-based place of each row in a total order, with no single task that holds all rows.

    Rows are dealt by range; each range is numbered by itself, and the ranges' sizes, a row for each partition, give what comes before. The
    dealt rows are a written table, as ranges drawn twice, or again after a loss, need not be the same.
    """
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    ranged = settled(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    numbered = ranged.withColumn("_local", local)
    sizes = ranged.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).select("_part", "_before")
    return numbered.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_local") - 1 + start).drop("_part", "_local", "_before")


def ranked(df: DataFrame, value: str, offset: str, groups: list[str], name: str = "ord", descending: bool = False) -> DataFrame:
    """Adds the 0-based rank of (value, offset) within each group."""
    v, o = (F.desc(value), F.desc(offset)) if descending else (F.asc(value), F.asc(offset))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(v, o)) - 1)

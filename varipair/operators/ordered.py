"""Ranks and running sums in an order, without a group in one task.

Rows are laid out in ranges of (group, order) and written once. A range is a piece; within a piece, and a group in it, ranks
and sums are local windows. What stands before a piece in its group follows from one row for each piece and group. So a group
that holds a third of all rows is spread over as many pieces as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a piece.
PIECE_ROWS = 1_000_000


def running(rows: DataFrame, by: list[str], order: list[Column | str], value: str | None = None, piece_rows: int | None = None) -> DataFrame:
    """rows with `rn`, the place from 1 in its group by `order` (ascending; ties in any order), and with `before`, the
    sum of `value` (1 if none) over the group's earlier rows. Null groups are a group. Rows are written once."""
    names = [f"_o{k}" for k in range(len(order))]
    keyed = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(n) for n, o in zip(names, order, strict=True)])
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = written(keyed, "ordered-rows")
    pieces = max(at_least, -(-keyed.count() // (piece_rows or PIECE_ROWS)))
    laid = written(keyed.repartitionByRange(pieces, *by, *names).withColumn("_piece", F.spark_partition_id()), "ordered-pieces")
    amount = F.col(value) if value else F.lit(1)
    here = Window.partitionBy("_piece", *by).orderBy(*names)
    local = laid.withColumn("_n", F.row_number().over(here).cast("long")).withColumn("_s", F.coalesce(F.sum(amount).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    total = laid.groupBy("_piece", *by).agg(F.count("*").alias("_c"), F.sum(amount).alias("_t"))
    total = total.select(F.col("_piece").alias("_p"), *[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"))
    on = (F.col("_piece") == F.col("_p")) if not by else [F.col("_piece") == F.col("_p"), *[F.col(b).eqNullSafe(F.col(f"_b{k}")) for k, b in enumerate(by)]]
    j = local.join(total, on)
    return j.select(*rows.columns, (F.col("_n") + F.col("_c0")).alias("rn"), (F.col("_s") + F.col("_t0")).alias("before"))

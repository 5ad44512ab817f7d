"""Ordered work per key as a distributed prefix scan: no window, array or task holds all rows of a key.

Rows are dealt by ranges of (key, order), so a key with any share of the rows lies in several slices. A first pass folds each
(key, slice) to an associative summary; the summaries of a key, one row a slice, are carried over in order; a second pass folds
the rows of each slice again, from what the slices before it have left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.sources.storage import kept


def joined(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left JOIN right on keys that may be null; right has each key once."""
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in key])
    return left.alias("_l").join(right.alias("_r"), same, how).select("_l.*", *[F.col(f"_r.{c}") for c in right.columns if c not in key])


class Scan:
    """The rows of a table, sliced by ranges of (key, order); order must be total inside a key.

    parts: the number of slices, by default as many as the session's shuffles have."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], parts: int | None = None):
        dealt = df.repartitionByRange(*([parts] if parts else []), *key, *order)
        self.key, self.order = key, order
        self.rows = kept(dealt.withColumn("_slice", F.spark_partition_id()), "slices")

    def _carried(self, rows: DataFrame, summary: Column, carry, name: str) -> DataFrame:
        """rows with name: what the slices before a row's slice come to. carry(summary column, window over these slices)."""
        before = Window.partitionBy(*self.key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        told = rows.groupBy(*self.key, "_slice").agg(summary.alias("_s")).select(*self.key, "_slice", carry(F.col("_s"), before).alias(name))
        return joined(rows, told, [*self.key, "_slice"])

    @property
    def _inside(self):
        return Window.partitionBy(*self.key, "_slice").orderBy(*self.order)

    def running_sum(self, value: Column, name: str, rows: DataFrame | None = None) -> DataFrame:
        """rows with name: the sum of value up to each row of its key, that row included."""
        rows = (self.rows if rows is None else rows).withColumn("_v", value)
        whole = self._carried(rows, F.sum("_v"), lambda s, w: F.coalesce(F.sum(s).over(w), F.lit(0)), "_c")
        return whole.withColumn(name, F.coalesce(F.sum("_v").over(self._inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) + F.col("_c")).drop("_v", "_c")

    def previous(self, value: Column, name: str, rows: DataFrame | None = None) -> DataFrame:
        """rows with name: value in the row before of the same key, null in the first one."""
        rows = (self.rows if rows is None else rows).withColumn("_v", F.struct(value.alias("v")))
        whole = self._carried(rows, F.max_by("_v", F.struct(*self.order)), lambda s, w: F.last(s).over(w), "_c")
        return whole.withColumn(name, F.coalesce(F.lag("_v").over(self._inside), F.col("_c")).getField("v")).drop("_v", "_c")

    def numbered(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """rows with name: the row's number in its key, from 1."""
        return self.running_sum(F.lit(1), name, rows)


def moving_average(df: DataFrame, key: list[str], order: list[str], value: Column, start: float, keep: float, parts: int | None = None) -> DataFrame:
    """key, folded: exponential moving average, keep * old + (1 - keep) * new, from start on.

    A slice is the affine map a -> keep^n a + b: b sums its values, each by its distance from the slice's end. The maps of a key's
    slices are composed the same way. A null value is passed over.
    """
    scan = Scan(df.withColumn("_x", value.cast("double")).where("_x IS NOT NULL"), key, order, parts)
    back = Window.partitionBy(*key, "_slice").orderBy(*[F.desc(c) for c in order])
    slices = scan.rows.withColumn("_d", F.row_number().over(back) - 1).groupBy(*key, "_slice").agg(F.count("*").alias("n"), F.sum((1.0 - keep) * F.col("_x") * F.pow(F.lit(keep), "_d")).alias("b"))
    after = Window.partitionBy(*key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("_d", F.coalesce(F.sum("n").over(after), F.lit(0)))
    return placed.groupBy(*key).agg((start * F.pow(F.lit(keep), F.sum("n")) + F.sum(F.col("b") * F.pow(F.lit(keep), "_d"))).alias("folded"))


def incidents(df: DataFrame, key: list[str], order: list[str], flag: Column, parts: int | None = None) -> DataFrame:
    """key, incidents: runs of consecutive flagged rows."""
    scan = Scan(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, parts)
    return scan.previous(F.col("_f"), "_p").groupBy(*key).agg(F.count_if(F.col("_f") & ~F.coalesce("_p", F.lit(False))).alias("incidents"))


def runs(df: DataFrame, key: list[str], order: list[str], flag: Column, parts: int | None = None) -> DataFrame:
    """key, length, first, last (structs of order), open: runs of consecutive flagged rows; open: the run reaches the key's last row."""
    scan = Scan(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, parts)
    marked = scan.running_sum(F.when(F.col("_f"), 0).otherwise(1), "_island")
    found = marked.where("_f").groupBy(*key, "_island").agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    ends = scan.rows.groupBy(*key).agg(F.max(F.struct(*order)).alias("_end"))
    return joined(found, ends, key).withColumn("open", F.col("last") == F.col("_end")).drop("_end", "_island")


def trailing(df: DataFrame, key: list[str], order: list[str], flag: Column, parts: int | None = None) -> DataFrame:
    """key, streak: how many rows at the end of a key are flagged one after another."""
    scan = Scan(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, parts)
    return scan.numbered("_n").groupBy(*key).agg((F.count("*") - F.coalesce(F.max(F.when(~F.col("_f"), F.col("_n"))), F.lit(0))).alias("streak"))

"""What the operators share: tables kept between rounds, joins on keys of any frequency, and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.sources.storage import dropped, kept, shared_dir

__all__ = ["block_join", "cleared", "dropped", "free_name", "kept", "salted_join", "shared_dir"]

#: At most HOT_SHARE keys, of over HOT_ROWS rows each, are dealt over SALTS parts.
HOT_SHARE, HOT_ROWS, SALTS = 4096, 1000, 64
#: Rows of a key that one task joins at once on either side, when both sides may have many.
BLOCK_ROWS = 4096


def cleared(df: DataFrame, outputs: list[str], inputs: list[str]) -> DataFrame:
    """df without the columns whose names the outputs take: an output replaces an old column of its name. Inputs are kept."""
    taken = {n.lower() for n in outputs} - {n.lower() for n in inputs}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The HOT_SHARE most frequent keys of counts (keys, n) among those with over HOT_ROWS rows; None if there are none.
    Every other key has at most 1/HOT_SHARE of all rows or HOT_ROWS rows."""
    found = counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOT_SHARE).select(*keys)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema).withColumn("_hot", F.lit(True)) if rows else None


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows JOIN table on keys, where one key may hold any share of the rows.

    table has each key once; counts has keys and n, the number of their rows. The hot keys are at most HOT_SHARE, so their list
    is broadcast; their rows are dealt over SALTS parts by a hash of `by`, and their table rows are repeated for each part.
    """
    hot = hot_keys(counts, keys)
    if hot is None:
        return rows.join(table, keys, how)
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    told = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return marked.join(told, [*keys, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, key: str, left_by: Column, right_by: Column) -> DataFrame:
    """left JOIN right (both read several times) on key, where a key may have any number of rows on both sides.

    Both sides of a key are cut into blocks of about BLOCK_ROWS rows, and blocks are joined with blocks: the pairs of a key are
    spread over as many tasks as it has pairs of blocks.
    """
    n_left = left.groupBy(key).agg(F.count("*").alias("n"))
    n_right = right.groupBy(key).agg(F.count("*").alias("n"))
    if n_left.where(F.col("n") > BLOCK_ROWS).limit(1).count() + n_right.where(F.col("n") > BLOCK_ROWS).limit(1).count() == 0:
        return left.join(right, key)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    both = n_left.join(n_right.withColumnRenamed("n", "m"), key).select(key, blocks("n").alias("_rows"), blocks("m").alias("_columns"))

    def dealt(side: DataFrame, counts: DataFrame, by: Column, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        placed = salted_join(side, both, [key], counts, by).withColumn(names[0], F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
        return placed.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_columns")

    one = dealt(left, n_left, left_by, "_rows", "_columns", ("_i", "_j"))
    two = dealt(right, n_right, right_by, "_columns", "_rows", ("_j", "_i"))
    return one.join(two, [key, "_i", "_j"]).drop("_i", "_j")

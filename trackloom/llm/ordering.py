"""Places of rows in one order, within groups of any size, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, checkpointed in ranges of the ascending keys (nulls first): part is the range's number, spot a row's place in it.

    The keys should tell all rows apart, then the ranges are of about equal size.  The sample for the
    ranges reads `rows` once more, so these should be checkpointed too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return checkpoint(ranged.withColumn("part", F.shiftright(number, 33)).withColumn("spot", number.bitwiseAND(F.lit((1 << 33) - 1))))


def groups_of(rows: DataFrame, group: str) -> DataFrame:
    """A row per range and group: part, group, first (its first spot there), before (its rows in earlier ranges), total.

    rows: of `placed`, whose first key is `group`.  A group has as many rows here as it has ranges.
    """
    here = rows.groupBy("part", group).agg(F.min("spot").alias("first"), F.count("*").alias("here"))
    own = Window.partitionBy(group)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return here.select("part", group, "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(own).alias("total"))


def ranked(groups: DataFrame, group: str) -> DataFrame:
    """group, total, rank: groups of `groups_of` by their order, from 0; ranks are counted in the ranges in which groups begin."""
    begins = groups.where("before = 0").select("part", group, "total")
    sizes = begins.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as there are ranges
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("part").alias("of"), offset.alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(group)) - 1
    numbered = begins.withColumn("own", own)
    return numbered.join(offsets, F.col("part") == F.col("of")).select(group, "total", (F.col("offset") + F.col("own")).alias("rank"))


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined with keyed, which has a row a key, on equal keys; keyed's other columns follow.

    weight: a column of `keyed` that bounds how many rows have the key; its sum bounds
    all rows.  Keys with more than 1 / share of that sum, fewer than `share` keys, are broadcast,
    so that no task of the shuffled rest has such a key.  Both tables should be checkpointed.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    more = [c for c in keyed.columns if c not in keys]
    named = [F.col(c).alias(f"other_{k}") for k, c in enumerate(keys)]
    heavy = F.col(weight) > total / share
    same = [F.col(c) == F.col(f"other_{k}") for k, c in enumerate(keys)]
    hot = rows.join(F.broadcast(keyed.where(heavy).select(*named, *more)), same)
    light = rows.join(F.broadcast(keyed.where(heavy).select(*named)), same, "left_anti")
    rest = light.join(keyed.where(~heavy).select(*named, *more), same, how)
    return hot.select(*rows.columns, *more).unionByName(rest.select(*rows.columns, *more))

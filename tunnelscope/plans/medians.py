"""Exact group medians and runner-up values without collecting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A group of up to this many rows is ranked whole; a larger one only around its middle.
WHOLE_GROUP_ROWS = 10_000
# Half width of the bracket around the middle: four times the sketch's greatest rank error, 1 / ACCURACY.
BRACKET = 0.002
ACCURACY = 2_000


def grouped_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact medians of ``columns`` per group, one row per group.

    A mergeable quantile sketch first brackets the middle of each group. All values under the
    bracket then count as one value, those above are not needed, and equal values are counted
    before the shuffle. What is left to sort per group is a thin slice around its middle. The bracket
    cannot miss: it is four times wider than the sketch's greatest rank error, and small groups have none.
    Should it miss, the query fails. Nulls and NaN are left out; a group without values has a null median.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    every = df.select(*keys, F.posexplode(values).alias("_measure", "_v"))
    long = every.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    group = [*keys, "_measure"]
    bounds = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("_b"),
    )
    small = F.col("_n") <= WHOLE_GROUP_ROWS
    bounds = bounds.select(
        *group,
        "_n",
        F.when(small, F.lit(float("-inf"))).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(small, F.lit(float("inf"))).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    under = F.when(F.col("_v") < F.col("_lo"), F.lit(float("-inf"))).otherwise(F.col("_v"))
    counted = (
        long.join(bounds, group)
        .where(F.col("_v") <= F.col("_hi"))
        .groupBy(*group, "_n", "_lo", under.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = F.sum("_c").over(
        Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_upto", upto)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def value_at(rank):
        covers = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        return F.max(F.when(covers, F.col("_v")))

    middle = ranked.groupBy(*group).agg(((value_at(low) + value_at(high)) / 2).alias("_median"), F.max("_lo").alias("_lo"))
    missed = F.col("_median").isNull() | ((F.col("_median") == float("-inf")) & (F.col("_lo") > float("-inf")))
    problem = F.raise_error(F.lit("the quantile sketch missed the middle of a group")).cast("double")
    middle = middle.withColumn("_median", F.when(missed, problem).otherwise(F.col("_median")))
    picks = [
        F.max(F.when(F.col("_measure") == i, F.col("_median"))).alias(c)
        for i, c in enumerate(columns)
    ]
    return middle.groupBy(*keys).agg(*picks)


def runner_up(df: DataFrame, keys: list[str], value: str, tiebreak: str, name: str) -> DataFrame:
    """Second-largest ``value`` per group (equal to the largest on a tie); no row for groups of one.

    The row-number limit is applied before the shuffle too, so each task hands on at most two rows of a group.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(value), tiebreak)
    return (
        df.select(*keys, value, tiebreak, F.row_number().over(order).alias("_rank"))
        .where(F.col("_rank") <= 2)
        .where(F.col("_rank") == 2)
        .select(*keys, F.col(value).alias(name))
    )

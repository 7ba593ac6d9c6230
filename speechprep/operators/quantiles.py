"""Exact percentiles of groups, of which one may hold most rows.

Small groups are sorted where they meet.  A larger one is narrowed down first: its values are counted in ``BINS`` equal
ranges, and for each wanted rank only the range that holds it is kept, with how many values lie below; this is repeated until
few enough values are left, or equal ones only.  Counts are made before rows are shuffled, so no task holds
a large group's values, and no value is left out or rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.sources.shared import new_folder

BINS, MOST_SORTED, MOST_BROADCAST, ROUNDS = 256, 100_000, 100_000, 80


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _side(df: DataFrame) -> DataFrame:
    """``df`` under a join hint: broadcast behind a check of its size."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df.hint("merge")


def _place() -> Column:
    """The range that a value falls into; infinities count as the largest numbers whose distance is finite."""
    low, high, value = (F.greatest(F.least(F.col(c), F.lit(8e307)), F.lit(-8e307)) for c in ("low", "high", "value"))
    return F.when(low < high, F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")


def percentiles(df: DataFrame, keys: list[str], value: str, p: float, most: int = MOST_SORTED) -> DataFrame:
    """(keys, n, value): of each group the number of its values and their percentile ``p`` between 0 and 1, interpolated; nulls and NaN don't count, groups without values have no row.

    Groups of more than ``most`` values are narrowed down.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).filter("value is not null and not isnan(value)")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))
    large = _kept(sizes.filter(F.col("n") > most).select("*", ranks.alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("left")), "quantiles")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", p).alias("value"))
    mine = [F.col(k).eqNullSafe(F.col(f"#{k}")) for k in keys]
    names = [F.col(k).alias(f"#{k}") for k in keys]
    few = rows.join(_side(large.select(*names)), mine, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", p).alias("value"))
    for _ in range(ROUNDS):
        if large.filter(F.col("left") > most).filter("low < high").isEmpty():
            break
        large = _kept(_narrowed(rows, large, keys), "quantiles")
    many = _inside(rows, large, keys).groupBy(*keys, "rank").agg(F.sort_array(F.collect_list(F.when(F.col("low") < F.col("high"), F.col("value")))).alias("values"), *[F.first(c).alias(c) for c in ("n", "low", "below")])
    found = many.select(*keys, "n", "rank", F.coalesce(F.get("values", (F.col("rank") - F.col("below")).cast("int")), F.col("low")).alias("x"))
    ends = found.groupBy(*keys).agg(F.first("n").alias("n"), F.min("rank").alias("rank"), F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (at - F.col("rank")))
    return few.unionByName(ends.select(*keys, "n", between.alias("value")))


def _inside(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the large groups that lie between their bounds, with these."""
    side = large.select(*[F.col(k).alias(f"#{k}") for k in keys], *[c for c in large.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"#{k}")) for k in keys] + [F.col("value") >= F.col("low"), F.col("value") <= F.col("high")]
    return rows.join(_side(side), on).drop(*[f"#{k}" for k in keys])


def _narrowed(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    counts = _inside(rows, large, keys).groupBy(*keys, "n", "rank", "below", _place().alias("bin")).agg(F.count("*").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
    end = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # of a range; BINS rows a rank
    held = counts.withColumn("end", end).filter((F.col("end") > F.col("rank")) & (F.col("end") - F.col("c") <= F.col("rank")))
    return held.withColumn("below", F.col("end") - F.col("c")).withColumnRenamed("c", "left").select(*large.columns)

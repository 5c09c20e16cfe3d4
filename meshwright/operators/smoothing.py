"""Gaussian smoothing matrices by a bucketed neighbourhood join."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smoothing_matrix(points: DataFrame, sigma: tuple[float, float, float], nsigma: float = 2.0, by_column: bool = False, parts: int = 1) -> DataFrame:
    """``(row, col, val)`` over ``points (idx, x, y, z, area)``: exp(-d^2 / 2) times the area of col, rows summing to 1.

    d is measured in sigmas along each axis and ends at ``nsigma``. Each point goes
    into one bucket of that size and looks into the 27 around it, an equi-join; a
    sigma of 0 leaves its axis out. With ``by_column`` the columns conserve mass
    instead: they sum to the area of their point.

    Pairs are never shuffled, stored or broadcast: they are gone through twice, for
    the sums, of which a task sends one a point, and for the entries. What is dealt
    out are the points, 27 times one of the two sides. Where many points share few
    buckets, ``parts`` deals the rows of a bucket over so many keys, each of which
    gets the bucket's columns: else the task of the fullest bucket is waited for.
    """
    axes = [(a, s) for a, s in zip("xyz", sigma, strict=True) if s > 0]
    if not axes:
        raise ValueError("smoothing needs a positive sigma")
    for _, s in axes:
        if s < 0:
            raise ValueError("sigma can't be negative")
    cell = lambda p, a, s: F.floor(F.col(f"{p}.{a}") / (nsigma * s)).cast("long")
    good = points.withColumn("area", F.when(F.col("area") > 0, F.col("area")).otherwise(F.raise_error(F.lit("a point without area can't be smoothed")).cast("double")))
    moves = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for (a, _), d in zip(axes, m, strict=True))) for m in product((-1, 0, 1), repeat=len(axes))))
    spark, split = points.sparkSession, ["part"] if parts > 1 else []
    near = [*(f"b{a}" for a, _ in axes), *split]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, part: Column) -> DataFrame:
        """By bucket and part, over tasks that aren't merged again for having few bytes: their pairs are many."""
        return side.withColumn("part", part).repartition(tasks, *near) if split else side

    def pairs(rows: DataFrame, cols: DataFrame) -> DataFrame:
        """Both points' columns, those of rows with ``q`` before them and of cols with ``t``, and d2."""
        t = cols.alias("t").select(*(F.col(f"t.{c}").alias(f"t{c}") for c in cols.columns), *(cell("t", a, s).alias(f"b{a}") for a, s in axes))
        q = rows.alias("q").select(*(F.col(f"q.{c}").alias(f"q{c}") for c in rows.columns), *(cell("q", a, s).alias(f"c{a}") for a, s in axes), F.explode(moves).alias("m"))
        q = q.select(*(f"q{c}" for c in rows.columns), *((F.col(f"c{a}") + F.col(f"m.d{a}")).alias(f"b{a}") for a, _ in axes))
        q, t = dealt(q, F.pmod(F.hash("qidx"), F.lit(parts))), dealt(t, F.explode(F.array(*map(F.lit, range(parts)))))
        away = [(F.col(f"t{a}") - F.col(f"q{a}")) / s for a, s in axes]
        d2 = reduce(add, (d * d for d in away))  # Spark's pow takes several times as long
        return q.join(t.hint("merge"), near).withColumn("d2", d2).filter(F.col("d2") < nsigma * nsigma)

    one = good.select("idx", "area", *(a for a, _ in axes))
    axis, area = ("t", "qarea") if by_column else ("q", "tarea")
    val = F.exp(-F.col("d2") / 2) * F.col(area)
    total = pairs(one, one).groupBy(F.col(f"{axis}idx").alias("idx")).agg(F.sum(val).alias("total"))
    summed = one.join(total.hint("merge"), "idx")
    every = pairs(one, summed) if by_column else pairs(summed, one)
    scaled = val / F.col(f"{axis}total")
    scaled = scaled * F.col("tarea") if by_column else scaled
    return every.select(F.col("qidx").alias("row"), F.col("tidx").alias("col"), scaled.alias("val"))

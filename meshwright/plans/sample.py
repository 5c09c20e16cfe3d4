"""Grid data drawn from the driver's tables: fields, exchange facts, elevations; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec
from ..operators.elevation import mask_to_elevation
from .registry import load

A16, B8, B5, COARSE = HntrSpec(16, 8), HntrSpec(8, 4), HntrSpec(10, 5, 0.5), HntrSpec(4, 2)
HCDEFS = [0.0, 400.0, 800.0, 1200.0, 1600.0, 2000.0, 2400.0]
N_A = 1000000  # more than any supplier key at these scales; class keys are ihc * N_A + a


def field(spark: SparkSession, sf: str, n: int = 128) -> DataFrame:
    """``(idx, value, weight)``: mean quantity and number of line items by part, folded onto n cells."""
    li = load(spark, sf, "lineitem").groupBy(F.pmod("l_partkey", F.lit(n)).alias("idx"))
    return li.agg((F.sum("l_quantity") / F.count("*")).alias("value"), F.count("*").cast("double").alias("weight"))


FIELD = "SELECT l_partkey % 128 AS idx, sum(l_quantity) / count(*) AS value, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1"


def exchange(spark: SparkSession, sf: str) -> DataFrame:
    """``(x_id, a_id, i_id, area)``: quantities by supplier and part."""
    li = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("a_id"), F.col("l_partkey").alias("i_id")).agg(F.sum("l_quantity").alias("area"))
    return li.select((F.col("a_id") * 10000000 + F.col("i_id")).alias("x_id"), "a_id", "i_id", "area")


EXCHANGE = "SELECT l_suppkey * 10000000 + l_partkey AS x_id, l_suppkey AS a_id, l_partkey AS i_id, sum(l_quantity) AS area FROM lineitem GROUP BY l_suppkey, l_partkey"


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """``(time, i_id, mask, topg, thk)``: parts as cells of an ice model's output."""
    codes = F.array(*(F.lit(c) for c in (0, 2, 3, 4, -1)))
    return load(spark, sf, "part").select(F.pmod("p_partkey", F.lit(2)).cast("int").alias("time"), F.col("p_partkey").alias("i_id"), F.get(codes, F.pmod("p_size", F.lit(5)).cast("int")).alias("mask"), (F.col("p_retailprice") * 0.999983217 - 1000).alias("topg"), (F.col("p_size") * 10.0).alias("thk"))


RASTER = "SELECT CAST(p_partkey % 2 AS INT) AS time, p_partkey AS i_id, ([0, 2, 3, 4, -1])[p_size % 5 + 1] AS mask, p_retailprice * 0.999983217::DOUBLE - 1000 AS topg, p_size * 10.0::DOUBLE AS thk FROM part"


def ice_mask(spark: SparkSession, sf: str) -> DataFrame:
    """``(i_id, elev)`` of all parts whose cell has ice."""
    _, ice = mask_to_elevation(F.col("mask"), F.col("topg"), F.col("thk"))
    return raster(spark, sf).select("i_id", ice.alias("elev")).filter("elev is not null")


ICE = f"SELECT i_id, topg + thk AS elev FROM ({RASTER}) WHERE mask IN (2, 3)"


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """``(a_id, native_area, proj_area)`` of suppliers."""
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("a_id"), (100.0 + F.pmod("s_suppkey", F.lit(7))).alias("native_area"), (101.0 + F.pmod("s_suppkey", F.lit(5))).alias("proj_area"))


AREAS = "SELECT s_suppkey AS a_id, 100.0::DOUBLE + s_suppkey % 7 AS native_area, 101.0::DOUBLE + s_suppkey % 5 AS proj_area FROM supplier"


def extent(df: DataFrame, column: str, least: int, spare: int) -> int:
    """The number of cells that hold every key of the table and ``spare`` ids beyond the last, ``least`` cells at least."""
    last = df.agg(F.max(column)).first()[0]
    return max(least, spare + (0 if last is None else last + 1))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0 is 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def rounded_shares(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """As rounded, for doubles from 0 to 1 and very many rows: half up in arithmetic, as DuckDB rounds. Spark's round goes through decimals."""
    return df.withColumns({c: F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits for c in columns})

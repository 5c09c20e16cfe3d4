"""Mixing sources to target weights.

A document's key is the MD5 of its id, so its rank within its source is random
but the same in every run. Places (source, key and what breaks ties) are sorted
over range partitions; the sums of partitions, added up, give each partition's
place in the order, and only the one partition of each source in which the budget
ends adds up its rows. That yields the place at which every source is cut, with
which each row then settles by itself what the mix takes of it. Texts are never
sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights of the sources in order, repeating, and the share of all words that they get.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the number of words of the text as ``size``; 0 for a null text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sums: DataFrame) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    A target is the lesser of ``MOST_EPOCHS`` times the source's size and its
    weight times one level common to all, which spends the whole share: what
    resharing the excess by weight again and again ends with. In the order of
    size to weight the capped sources come first, so two running sums find it.
    The table has one row a source.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sums.withColumn("w", w).withColumn("cap", F.lit(MOST_EPOCHS) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") * 10 / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("share", F.lit(SHARE) * F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("rest") <= (F.col("share") - F.col("before")) * F.col("w"))
    free = F.col("share") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    heavy = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.try_divide(F.col("w") * free, heavy)).alias("target"))


def _ordered(rows: DataFrame) -> DataFrame:
    """``(source, place, size)`` sorted by source and place over range partitions, with the number ``part`` of each."""
    order = ("source", "place")
    rows = scratch(rows, "places")  # finding the ranges reads them once more
    out = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")
    discard(rows)
    return out


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``rows``, which have a ``size``, with ``source_size``, ``target`` and ``taken``.

    ``taken`` counts the words of the row that the mix takes: whole epochs of its
    source as often as they fit into the target, and one more time if it stands
    before the point where the rest of the budget ends; the row at that point
    gives the part that is missing. Null sources are one source, the last; a null
    id has the key of the empty string; rows that tie on key are ordered by id, size
    and a hash of all their columns, and rows that are equal in every column stand
    in any order. A source without words takes none; an empty table gives an empty
    one. Columns called ``source_size``, ``target`` or ``taken`` are replaced, other
    columns pass through. ``rows`` is read twice.
    """
    rows = rows.drop("source_size", "target", "taken")
    keep = rows.columns
    hashed = F.md5(F.coalesce(rows[id_col].cast("string"), F.lit("")).cast("binary"))
    # a place takes few bytes; the rows themselves are never sorted
    place = F.struct(hashed.alias("key"), rows[id_col].alias("id"), rows["size"].alias("size"), F.xxhash64(*(rows[c] for c in keep)).alias("tie"))
    placed = rows.select(F.struct(*(rows[c] for c in keep)).alias("row"), rows[source_col].alias("source"), place.alias("place"), rows["size"].alias("size"))
    ordered = _ordered(placed.select("source", "place", "size"))
    sums = scratch(ordered.groupBy("source", "part").agg(F.sum("size").alias("n")), "sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    budget = F.floor("target").cast("long")
    targets = targets.withColumn("epochs", F.coalesce(F.try_divide(budget, F.col("source_size")).cast("long"), F.lit(0)))
    targets = scratch(targets.withColumn("left", budget - F.col("epochs") * F.col("source_size")), "targets")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the part of each source in which the rest of its budget ends, and how much of it is left there
    cut = sums.withColumn("ahead", ahead).withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")))
    cut = cut.filter((F.col("ahead") <= F.col("left")) & (F.col("left") < F.col("ahead") + F.col("n"))).select("s", F.col("part").alias("p"), (F.col("left") - F.col("ahead")).alias("rest"))
    inside = ordered.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    upto = F.sum("size").over(Window.partitionBy("source", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ends = inside.withColumn("upto", upto).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
    # of rows with one place, all before the end are taken whole
    before = inside.join(ends.select(F.col("source").alias("es"), F.col("place").alias("end")), F.col("source").eqNullSafe(F.col("es")) & (F.col("place") < F.col("end"))).groupBy(F.col("source").alias("bs")).agg(F.sum("size").alias("before"))
    ends = ends.select(F.col("source").alias("es"), F.col("place").alias("end"), "rest").join(before, F.col("es").eqNullSafe(F.col("bs")), "left")
    ends = ends.select("es", "end", (F.col("rest") - F.coalesce("before", F.lit(0))).alias("part"))
    plan = scratch(targets.join(ends, F.col("source").eqNullSafe(F.col("es")), "left").withColumnRenamed("source", "s"), "plan")
    discard(sums, targets, ordered)
    planned = placed.join(plan, F.col("source").eqNullSafe(F.col("s")))
    at_end = F.coalesce(F.col("place") == F.col("end"), F.lit(False))
    plain = planned.filter(~at_end).withColumn("once", F.when(F.col("place") < F.col("end"), F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("source", "place").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    edge = planned.filter(at_end).withColumn("once", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - upto + F.col("size"))))
    out = plain.unionByName(edge)
    return out.select("row.*", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("once")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS share,
         coalesce(CAST(sum(2 * source_size) OVER (ORDER BY CAST(20 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
         CAST(sum(w) OVER (ORDER BY CAST(20 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s
), f AS (
  SELECT *, cap * rest <= (share - before) * w AS full_ FROM o
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(cap AS DOUBLE)
    ELSE (w * (share - CAST(sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS BIGINT))) / CAST(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS BIGINT) END AS target FROM f
), g AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - ahead)) END AS taken
FROM g
"""

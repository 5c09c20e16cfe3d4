"""Helpers that every text operator shares: shared scratch tables, key columns, bounded Arrow pieces."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable

#: A missing id sorts below every id, or above every id, where an operator compares ids.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Text bytes that one numpy pass works on; a single longer text is a piece of its own.
PIECE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return path.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts lineage, and lost executors don't take it along.

    The shuffle files of the write are of no more use once it is done, and go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshwright-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _LIVE.setdefault(spark.sparkContext.applicationId, {})[path] = None
    return out


#: Scratch tables that are still there, by application; results that are read later need some of them.
_LIVE: dict[str, dict[str, None]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _LIVE.get(spark.sparkContext.applicationId, {}).pop(path, None)


def stored(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The scratch table of what ``make`` returns, and none of those that it needed on the way."""
    before = set(_LIVE.get(spark.sparkContext.applicationId, ()))
    out = scratch(make(), name)
    for path in set(_LIVE[spark.sparkContext.applicationId]) - before - {out.scratch_path}:
        _delete(spark, path)
    return out


def key(column: Column, missing: int) -> Column:
    return F.coalesce(column.cast("long"), F.lit(missing))


def unkey(column: Column, missing: int) -> Column:
    return F.when(column != missing, column)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, whole rows always."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text)).cast(pa.large_binary())
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, len(column), at + 65536)
            yield batch.slice(at, to - at)
            at = to


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run, kind) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES at most: ten thousand texts at once would not fit small executors.

    The session's own bound stays if it is smaller.
    """
    reachable(df.sparkSession)
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")  # read when the result is, so it stays
    return df.mapInArrow(run, kind)


def table(names_types: str, *columns) -> pa.RecordBatch:
    """A record batch from columns in the order of a ``name:type`` list."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32())}
    fields = [x.split(":") for x in names_types.split()]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def schema(names_types: str) -> str:
    """The Spark schema of the same list."""
    kinds = {"longs": "array<long>", "ints": "array<int>"}
    return ", ".join(f"{n} {kinds.get(t, t)}" for n, t in (x.split(":") for x in names_types.split()))


def routed(few: DataFrame, many: DataFrame, few_size: Column, few_bound: int, many_size: Column, many_bound: int) -> tuple[DataFrame, DataFrame]:
    """Bring the rows of ``few`` and ``many`` with one ``group`` together, in tasks of bounded size however large a group is.

    A group's rows of ``few`` are dealt to parts of about ``few_bound``, and every
    part meets all rows of ``many`` of its group; these are dealt to salts of about
    ``many_bound``, and every salt has a copy of the part. So each pair of rows meets
    exactly once. Returned are the rows ``group, sub, salt, kind`` and both tables'
    other columns, sorted by these four, those of ``few`` (kind 0) first; and a
    scratch table that they read. Groups without rows on both sides are left out.
    ``many`` is read twice and should be stored.
    """
    parts = lambda size, bound: F.ceil(F.sum(size) / F.lit(bound)).cast("int")
    plan = few.groupBy("group").agg(parts(few_size, few_bound).alias("subs")).join(many.groupBy("group").agg(parts(many_size, many_bound).alias("salts")), "group")
    plan = scratch(plan.select("group", F.greatest("subs", F.lit(1)).alias("subs"), F.greatest("salts", F.lit(1)).alias("salts")), "plan")
    own, other = ([c for c in df.columns if c != "group"] for df in (few, many))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, names: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    a = few.join(plan, "group").select("group", one("subs", own).alias("sub"), each("salts").alias("salt"), F.lit(0).alias("kind"), *own, *none(many, other))
    b = many.join(plan, "group").select("group", each("subs").alias("sub"), one("salts", other).alias("salt"), F.lit(1).alias("kind"), *none(few, own), *other)
    return a.union(b).repartition("group", "sub", "salt").sortWithinPartitions("group", "sub", "salt", "kind"), plan


def routed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """What ``routed`` brings to a task as (a new part begins, kind, rows of this kind without the first four columns)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tags = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)])
        cut = np.r_[0, np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        rest = batch.select(range(4, batch.num_columns))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = tuple(tags[:3, a])
            yield own != last, int(tags[3, a]), rest.slice(a, b - a)
            last = own


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

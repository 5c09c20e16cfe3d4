"""Grids, exchange grids, matrices, fields and topography as Parquet tables, and a registry of readers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec, LonLatSpec, XYSpec, lonlat_from_hntr
from ..operators.coo import WeightedMatrix
from ..operators.elevation import elevmasks

VERSION = 2
_SPECS = {"hntr": HntrSpec, "lonlat": LonLatSpec, "xy": XYSpec}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a local one only where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spec_to_json(spec) -> str:
    kind = next(k for k, c in _SPECS.items() if isinstance(spec, c))
    return json.dumps({"type": kind, "version": VERSION} | asdict(spec))


def spec_from_json(text: str):
    """A grid description by its type; another version raises."""
    d = json.loads(text)
    kind, version = d.pop("type"), d.pop("version")
    if kind not in _SPECS:
        raise ValueError(f"unknown grid type {kind!r}")
    if version != VERSION:
        raise ValueError(f"grid version {version} is not {VERSION}")
    return _SPECS[kind](**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def write_grid(cells: DataFrame, spec, path: str, name: str, sproj: str = "") -> None:
    """Cells sorted by id, and a header row with the grid's full size."""
    dup = cells.groupBy("cell_id").count().filter("count > 1").limit(1)
    if not dup.isEmpty():
        raise ValueError("a cell id occurs twice")
    full = getattr(spec, "size", None) or (spec.nlon * spec.nlat if isinstance(spec, LonLatSpec) else spec.nx * spec.ny)
    cells.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/cells")
    head = cells.sparkSession.createDataFrame([(name, full, sproj, spec_to_json(spec))], "name string, n_full long, sproj string, spec string")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def read_grid(spark: SparkSession, path: str, full: bool = True) -> tuple[DataFrame, object, dict]:
    """(cells, description, header); without ``full`` the rings are not read."""
    head = spark.read.parquet(f"{path}/grid").first().asDict()
    cells = spark.read.parquet(f"{path}/cells")
    return (cells if full else cells.drop("ring")), spec_from_json(head["spec"]), head


def write_exchange(exchange: DataFrame, path: str, sheet: str) -> None:
    exchange.withColumn("sheet", F.lit(sheet)).write.mode("append").partitionBy("sheet").parquet(path)


def read_exchange(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("sheet") == sheet).drop("sheet")


def write_matrix(m: WeightedMatrix, path: str, spec: str) -> None:
    """Entries, both weight vectors and the flags, by name of the matrix."""
    m.M.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/matrix/spec={spec}")
    both = m.wM.withColumn("side", F.lit("row")).union(m.Mw.withColumn("side", F.lit("col")))
    both.write.mode("overwrite").option("compression", "zstd").partitionBy("side").parquet(f"{path}/weights/spec={spec}")
    m.M.sparkSession.createDataFrame([(m.conservative, m.scaled)], "conservative boolean, scaled boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/spec={spec}")


def read_matrix(spark: SparkSession, path: str, spec: str) -> WeightedMatrix:
    w = spark.read.parquet(f"{path}/weights/spec={spec}")
    meta = spark.read.parquet(f"{path}/meta/spec={spec}").first()
    side = lambda s: w.filter(F.col("side") == s).select("idx", "w")
    return WeightedMatrix(spark.read.parquet(f"{path}/matrix/spec={spec}"), side("row"), side("col"), meta["conservative"], meta["scaled"])


def append_step(df: DataFrame, path: str, step: int) -> None:
    """A step of a log along time; writing a step again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/step={step}")


def last_step(spark: SparkSession, path: str, column: str = "time") -> DataFrame:
    """The rows of the last time."""
    df = spark.read.parquet(path)
    return df.join(F.broadcast(df.agg(F.max(column).alias(column))), column, "left_semi")


def named_variables(spark: SparkSession, files: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """One wide table of ``{name: (path, column)}``; several names from one file are one scan."""
    by_path: dict[str, list[tuple[str, str]]] = {}
    for name, (path, column) in files.items():
        by_path.setdefault(path, []).append((name, column))
    out = None
    for path, cols in by_path.items():
        part = spark.read.parquet(path).select(*keys, *(F.col(c).alias(n) for n, c in cols))
        out = part if out is None else out.join(part, list(keys))
    return out


MASKS = ("mergemask", "underice")


def write_topography(df: DataFrame, path: str, keys: tuple[str, ...] = ("idx", "cell", "ihc", "j", "i")) -> None:
    """Topography on any grid: fields as doubles, masks as shorts, keys as they are, sorted by the first of them."""
    first = next(k for k in keys if k in df.columns)
    kinds = {c: "short" if c in MASKS else "double" for c in df.columns if c not in keys}
    df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).repartitionByRange(first).sortWithinPartitions(*(k for k in keys if k in df.columns)).write.mode("overwrite").parquet(path)


def write_merged(topoo: DataFrame, e_v_o: WeightedMatrix, classes: DataFrame, path: str) -> None:
    """Ocean-grid topography with the sheets merged in, its matrix to elevation classes, and the classes' elevations."""
    write_topography(topoo, f"{path}/topoo")
    write_matrix(e_v_o, path, "EvO")
    classes.coalesce(1).sortWithinPartitions("ihc").write.mode("overwrite").parquet(f"{path}/classes")


def write_overlap(a: tuple[DataFrame, object, str], i: tuple[DataFrame, object, str], exchange: DataFrame, path: str) -> None:
    """Two grids ``(cells, description, name)`` and their exchange grid, side by side in one folder."""
    for cells, spec, name in (a, i):
        write_grid(cells, spec, f"{path}/{name}", name, getattr(spec, "sproj", ""))
    write_exchange(exchange, f"{path}/exchange", i[2])


def grid_from_spec(spark: SparkSession, text: str, path: str, name: str) -> DataFrame:
    """Generate the cells of a description in JSON and write them; regular grids become boundary grids."""
    from . import gridgen

    spec = spec_from_json(text)
    full = lonlat_from_hntr(spec) if isinstance(spec, HntrSpec) else spec
    cells = gridgen.xy_cells(spark, full) if isinstance(full, XYSpec) else gridgen.lonlat_cells(spark, full)
    write_grid(cells, full, path, name, getattr(full, "sproj", ""))
    return read_grid(spark, path)[0]


#: The fields of an ocean-grid topography bundle, and those that one merged with ice sheets has besides.
TOPOO = ("focean", "flake", "fgrnd", "fgice", "zatmo", "zlake", "zicetop", "foceanf", "fgicef", "zatmof")
TOPOO_MERGED = (*TOPOO, "zland_min", "zland_max", "mergemask")


def read_topoo(spark: SparkSession, path: str, merged: bool = False) -> DataFrame:
    """The fields of a bundle by name; a missing one raises."""
    df = spark.read.parquet(path)
    names = TOPOO_MERGED if merged else TOPOO
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no {', '.join(missing)} in {path}")
    return df.select("idx", *names)


#: The code of Greenland in the ocean mask, and the depth of the sea that takes its place.
GREENLAND_CODE, GREENLAND_DEPTH = 2.0, -300.0


def separate_greenland(raw: DataFrame, separate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw fields ``(..., focean, elev)`` without Greenland, and Greenland's own cells; or, not separated, with it as land.

    Greenland is where ``focean`` has its code. Without it there is a shallow sea; its
    own table has ``focean`` 0.
    """
    here = F.col("focean") == GREENLAND_CODE
    own = raw.filter(here).withColumn("focean", F.lit(0.0))
    if not separate:
        return raw.withColumn("focean", F.when(here, 0.0).otherwise(F.col("focean"))), own.limit(0)
    return raw.withColumns({"focean": F.when(here, 1.0).otherwise(F.col("focean")), "elev": F.when(here, GREENLAND_DEPTH).otherwise(F.col("elev"))}), own


#: Readers of elevation masks by the prefix of ``type:path``.
ELEVMASK_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pism": lambda spark, path: elevmasks(spark.read.parquet(path))}


def read_elevmask(spark: SparkSession, source: str) -> DataFrame:
    """``(kind, i_id, elev)`` of ``type:path``."""
    kind, sep, path = source.partition(":")
    if not sep or kind not in ELEVMASK_READERS:
        raise ValueError(f"unknown kind of elevation mask: {source!r}")
    return ELEVMASK_READERS[kind](spark, path)

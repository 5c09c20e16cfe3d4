"""Exchange grids of polygon grids: tile-bucket equi-join, box filter, clipping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..workers import reachable

Point = tuple[float, float]


def is_convex(ring: list[Point]) -> bool:
    turns = [(bx - ax) * (cy - by) - (by - ay) * (cx - bx) for (ax, ay), (bx, by), (cx, cy) in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True)]
    scale = max(map(abs, turns), default=0.0)
    return all(t >= -1e-12 * scale for t in turns)


def clip(subject: list[Point], window: list[Point]) -> list[Point]:
    """The part of a polygon inside a convex counter-clockwise one: cut by each of its edges in turn."""
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        cut: list[Point] = []
        for k, (p, s) in enumerate(zip(out, side, strict=True)):
            q, t = out[k - 1], side[k - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                cut.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        out = cut
        if not out:
            break
    return out


def area(ring: list[Point]) -> float:
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def triangles(ring: list[Point]) -> list[list[Point]]:
    """A simple counter-clockwise polygon cut into triangles, one ear after another."""
    left, out = list(ring), []
    while len(left) > 3:
        for k in range(len(left)):
            ear = [left[k - 1], left[k], left[(k + 1) % len(left)]]
            if area(ear) <= 0:
                continue
            others = (q for q in left if q not in ear)
            if not any(all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in zip(ear, ear[1:] + ear[:1], strict=True)) for x, y in others):
                out.append(ear)
                break
        else:
            k = min(range(len(left)), key=lambda k: abs(area([left[k - 1], left[k], left[(k + 1) % len(left)]])))  # no ear but flat corners
        del left[k]
    return [*out, left]


def shared(subject: list[Point], window: list[Point], convex: tuple[bool, bool]) -> tuple[float, list[Point] | None]:
    """The area that two counter-clockwise polygons share, and its ring where one of them is convex.

    Where a concave polygon is cut into several pieces, the ring joins them by edges
    without area.
    """
    if not any(convex):
        return sum(max(0.0, area(clip(subject, t))) for t in triangles(window)), None
    piece = clip(subject, window) if convex[1] else clip(window, subject)
    return (area(piece) if len(piece) > 2 else 0.0), piece


def exchange_grid(a: DataFrame, i: DataFrame, tile: float | None = None, tiny: float = 1e-12, rings: bool = False) -> DataFrame:
    """``(a_id, i_id, area[, ring])``: the shared polygons of two grids ``(cell_id, ring)`` on one plane.

    Each cell goes to all tiles that its box touches, the join is on tiles, and a
    pair is taken only in the tile that holds the corner where both boxes begin, so
    none comes twice. ``tile`` is the tiles' size, by default four times the extent
    that nine tenths of the finer grid's cells don't exceed. Cells may be concave; with ``rings`` a pair of
    two concave cells raises. Overlaps up to ``tiny`` times the smaller cell are dropped.
    """
    reachable(a.sparkSession)
    a = a.select(F.col("cell_id").alias("a_id"), F.col("ring").alias("ra"), geometry.box(F.col("ring")).alias("ba"))
    i = i.select(F.col("cell_id").alias("i_id"), F.col("ring").alias("ri"), geometry.box(F.col("ring")).alias("bi"))
    if tile is None:
        extent = F.greatest(F.col("bi.x1") - F.col("bi.x0"), F.col("bi.y1") - F.col("bi.y0"))
        usual, widest = i.agg(F.percentile_approx(extent, 0.9).alias("q"), F.max(extent).alias("w")).first()
        # a few large cells take several tiles each, rather than making the tiles of all others coarse
        tile = max(4 * float(usual or 0.0), float(widest or 0.0) / 16) or 1.0
    t = lambda c: F.floor(c / tile).cast("long")
    tiled = lambda df, b: df.withColumn("tx", F.explode(F.sequence(t(F.col(f"{b}.x0")), t(F.col(f"{b}.x1"))))).withColumn("ty", F.explode(F.sequence(t(F.col(f"{b}.y0")), t(F.col(f"{b}.y1")))))
    pairs = tiled(a, "ba").join(tiled(i, "bi"), ["tx", "ty"])
    x0, y0 = F.greatest("ba.x0", "bi.x0"), F.greatest("ba.y0", "bi.y0")
    pairs = pairs.filter((x0 < F.least("ba.x1", "bi.x1")) & (y0 < F.least("ba.y1", "bi.y1")) & (F.col("tx") == t(x0)) & (F.col("ty") == t(y0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], tuple[list[Point], float, bool]] = {}

        def ring_of(kind: str, key: int, ring) -> tuple[list[Point], float, bool]:
            got = known.get((kind, key))
            if got is None:
                pts = [(v["x"], v["y"]) for v in ring]
                size = area(pts)
                if size < 0:
                    pts, size = pts[::-1], -size
                if len(known) > 10000:
                    known.clear()
                got = known[kind, key] = pts, size, is_convex(pts)
            return got

        for pdf in batches:
            out = []
            for a_id, ra, i_id, ri in pdf[["a_id", "ra", "i_id", "ri"]].itertuples(index=False):
                (pa_, sa, ca), (pi, si, ci) = ring_of("a", a_id, ra), ring_of("i", i_id, ri)
                size, piece = shared(pi, pa_, (ci, ca))
                if rings and piece is None:
                    raise ValueError(f"cells {a_id} and {i_id} are both concave and have no one ring")
                if size > tiny * min(sa, si):
                    out.append((a_id, i_id, size, [{"vid": None, "x": x, "y": y} for x, y in piece] if rings else None))
            yield pd.DataFrame(out, columns=["a_id", "i_id", "area", "ring"])

    out = pairs.select("a_id", "ra", "i_id", "ri").mapInPandas(run, f"a_id long, i_id long, area double, ring {geometry.RING}")
    return out if rings else out.drop("ring")


def filter_exchange(exchange: DataFrame, cells: DataFrame, keep_a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exchange cells of the A cells kept (``a_id``), and the I cells that they touch."""
    x = exchange.join(keep_a.select("a_id").distinct(), "a_id", "left_semi")
    return x, cells.join(x.select(F.col("i_id").alias("cell_id")).distinct(), "cell_id", "left_semi")

"""What an animal did at the same hour on days before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators.tracks import ANIMAL


def _nearest(offsets: np.ndarray, tolerance_s: float, names: list[str]):
    """Batches in the order of animal, block, fixes by time, origins -> a row for each origin and offset. Fixes of one animal and block are held."""

    def run(batches):
        group, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in range(3):  # animal and block; a null equals no fix's
                key = np.asarray(batch.column(c).dictionary_encode().indices.fill_null(-1))
                new[1:] |= key[1:] != key[:-1]
            g = np.cumsum(new)
            name = lambda k: tuple(batch.column(c)[k].as_py() for c in range(3))  # noqa: B023, E731
            is_fix = np.asarray(batch.column(3))
            t = batch.column(4).to_numpy(zero_copy_only=False)
            fg, ft, lat, lon = g[is_fix], t[is_fix], *(batch.column(c).filter(pa.array(is_fix)) for c in (5, 6))
            if name(0) == group:
                fg, ft = np.concatenate([np.zeros(len(held[0]), fg.dtype), fg]), np.concatenate([held[0], ft])
                lat, lon = pa.concat_arrays([held[1], lat]), pa.concat_arrays([held[2], lon])
            one = np.ones(len(ft), bool)  # of fixes at one time the first
            one[1:] = (fg[1:] != fg[:-1]) | (ft[1:] != ft[:-1])
            fg, ft, lat, lon = fg[one], ft[one], lat.filter(pa.array(one)), lon.filter(pa.array(one))
            k = int(np.searchsorted(fg, g[-1]))
            group, held = name(batch.num_rows - 1), (ft[k:], lat.slice(k), lon.slice(k))

            own = batch.filter(pa.array(~is_fix)).select(names)
            n, m = len(ft), own.num_rows
            if not m:
                continue
            last = np.repeat(t[~is_fix], len(offsets))
            q, qg = last + np.tile(offsets, m), np.repeat(g[~is_fix], len(offsets))
            order = np.lexsort((np.arange(n + len(q)) >= n, np.concatenate([ft, q]), np.concatenate([fg, qg])))
            seen, asks = np.cumsum(order < n), order >= n
            at = np.empty(len(q), np.int64)
            at[order[asks] - n] = seen[asks] - 1
            fg, ft = np.append(fg, -1), np.append(ft, np.nan)  # for places beyond either end

            def gap(i):
                ok = (fg[i] == qg) & (np.abs(ft[i] - q) <= tolerance_s) & (ft[i] <= last) & (q <= last)  # noqa: B023
                return np.where(ok, np.abs(ft[i] - q), np.inf)  # noqa: B023

            back, ahead = gap(at), gap(at + 1)
            best = pa.array(np.where(back <= ahead, at, at + 1), mask=np.isinf(np.minimum(back, ahead)))
            whose = pa.array(np.repeat(np.arange(m), len(offsets)))
            cols = [own.column(c).take(whose) for c in range(len(names))]
            cols += [pa.array(np.tile(np.arange(len(offsets), dtype=np.int32), m)), pa.array(ft).take(best), lat.take(best), lon.take(best)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "fix_t", "fix_lat", "fix_lon"])

    return run


def nearest_before(origins: DataFrame, fixes: DataFrame, offsets: list[float], tolerance_s: float, ordinal: str | None = None) -> DataFrame:
    """A row for each origin and each of the offsets, seconds from its t_last: the fix of the same animal nearest to that time, within the tolerance and not after t_last.

    Columns: those of the origin but its animal, n (the offset's place), fix_t, fix_lat, fix_lon. Of equally near fixes
    the earlier counts, of fixes at one time the last by `ordinal`, then the first by place; without one all three are null.

    Time is cut in blocks of the farthest offset and the tolerance, so an origin needs the fixes of its block and the one
    before. Both tables are dealt out by animal and block once, before offsets are spread; nothing is broadcast. A task
    holds the fixes of one animal and two blocks, and merges them with the times asked.
    """
    span = float(max(0.0, -min(offsets)) + tolerance_s)
    block = lambda t: F.floor(F.col(t) / span)
    own = [c for c in origins.columns if c not in ANIMAL]
    o = origins.select(*ANIMAL, block("t_last").alias("__block"), F.lit(False).alias("__fix"), F.col("t_last").cast("double").alias("__t"), *own)
    f = fixes.dropna(subset=[*ANIMAL, "t"]).select(
        *ANIMAL, F.explode(F.array(block("t"), block("t") + 1)).alias("__block"), F.lit(True).alias("__fix"), F.col("t").cast("double").alias("__t"),
        F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon"), *([F.col(ordinal).alias("__at")] if ordinal else []),
    )
    x = o.unionByName(f, allowMissingColumns=True).repartition(*ANIMAL, "__block")
    x = x.sortWithinPartitions(*ANIMAL, "__block", F.desc("__fix"), "__t", *([F.desc("__at")] if ordinal else []), "__lat", "__lon")
    x = x.select(*ANIMAL, "__block", "__fix", "__t", "__lat", "__lon", *own)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in origins.select(*own).dtypes), "n int, fix_t double, fix_lat double, fix_lon double"])
    return x.mapInArrow(_nearest(np.array(offsets, float), float(tolerance_s), own), schema)


def memory_steps(origins: DataFrame, fixes: DataFrame, horizon: int, dt_s: float, days: int, clip_m: float = 25_000, ordinal: str | None = None) -> DataFrame:
    """By origin (event_id, t_last, lat0, lon0) and step k: the place at that time on each of `days` days before.

    d1_dx, d1_dy, d1_avail: the day before; mean_dx, mean_dy: over days with a fix; frac: their
    share; spread: root mean square distance from the mean. Coordinates are clipped before all that.
    event_id tells origins apart; those without it have no fixes. Of fixes in one second the last by `ordinal` counts.
    """
    offsets = [k * dt_s - d * 86400 for k in range(1, horizon + 1) for d in range(1, days + 1)]
    x = nearest_before(origins, fixes, offsets, dt_s / 2, ordinal).withColumns({"k": F.expr(f"cast(n div {days} as int) + 1"), "d": F.expr(f"n % {days} + 1")})
    cut = lambda c: F.when(c.isNotNull() & F.col("event_id").isNotNull(), F.least(F.greatest(c, F.lit(-float(clip_m))), F.lit(float(clip_m))))
    dx, dy = geo.local_xy(F.col("fix_lat"), F.col("fix_lon"), F.col("lat0"), F.col("lon0"))
    x = x.select("event_id", "k", "d", cut(dx).alias("x"), cut(dy).alias("y"))
    first = lambda c: F.coalesce(F.max(F.when(F.col("d") == 1, F.col(c))), F.lit(0.0))
    var = F.coalesce(F.var_pop("x"), F.lit(0.0)) + F.coalesce(F.var_pop("y"), F.lit(0.0))
    return x.groupBy("event_id", "k").agg(
        first("x").alias("d1_dx"), first("y").alias("d1_dy"), F.max(F.when(F.col("d") == 1, F.col("x").isNotNull().cast("int"))).alias("d1_avail"),
        F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean_dx"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean_dy"),
        (F.count("x") / days).alias("frac"), F.sqrt(var).alias("spread"),
    )

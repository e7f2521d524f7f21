"""Scores of forecasts: baselines, displacement errors, energy score, hexagon cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.tracks import ANIMAL


def baseline_errors(steps: DataFrame, length: int) -> DataFrame:
    """Errors of standing still (cp) and of going on as in the last step (cv), for each target step of displacements()."""
    w = Window.partitionBy(*ANIMAL, "seg", "start")
    last = lambda c: F.max(F.when(F.col("pos") == length - 1, F.col(c))).over(w)
    out = steps.withColumn("vx", last("dx")).withColumn("vy", last("dy")).where(F.col("pos") >= length).withColumn("step", F.col("pos") - length + 1)
    return out.withColumn("cp_m", F.hypot("x", "y")).withColumn("cv_m", F.hypot(F.col("x") - F.col("step") * F.col("vx"), F.col("y") - F.col("step") * F.col("vy")))


def per_horizon(errors: DataFrame) -> DataFrame:
    """Mean error and root mean square over both axes, by step."""
    return errors.groupBy("step").agg(F.avg("cp_m").alias("ade_cp"), F.avg("cv_m").alias("ade_cv"), F.sqrt(F.avg((F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2)).alias("rmse_cp"), F.count("*").alias("n"))


def per_window(errors: DataFrame) -> DataFrame:
    """Mean and last error of each window."""
    return errors.groupBy(*ANIMAL, "seg", "start").agg(F.avg("cp_m").alias("ade_cp"), F.max_by("cp_m", "step").alias("fde_cp"), F.avg("cv_m").alias("ade_cv"), F.max_by("cv_m", "step").alias("fde_cv"))


def energy_score(samples: str, tx, ty):
    """Energy score of an array<struct<x,y>> column against a point: unbiased, norms sqrt(d2 + 1e-9), the diagonal included."""
    first = f"aggregate({samples}, 0d, (s, a) -> s + sqrt(pow(a.x - ({tx}), 2) + pow(a.y - ({ty}), 2) + 1e-9)) / size({samples})"
    pairs = f"aggregate({samples}, 0d, (s, a) -> s + aggregate({samples}, 0d, (u, b) -> u + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + 1e-9)))"
    return F.expr(f"if(size({samples}) > 1, {first} - {pairs} / (2d * size({samples}) * (size({samples}) - 1)), {first})")


def spatial_median(samples: str, rounds: int = 30):
    """Weiszfeld's iteration from the mean, `rounds` times, over an array<struct<x,y>> column."""
    mean = f"named_struct('x', aggregate({samples}, 0d, (s, a) -> s + a.x) / size({samples}), 'y', aggregate({samples}, 0d, (s, a) -> s + a.y) / size({samples}))"
    w = "1d / greatest(sqrt(pow(a.x - z.x, 2) + pow(a.y - z.y, 2)), 1e-6d)"
    fold = f"aggregate({samples}, named_struct('w', 0d, 'x', 0d, 'y', 0d), (s, a) -> named_struct('w', s.w + {w}, 'x', s.x + a.x * {w}, 'y', s.y + a.y * {w}), s -> named_struct('x', s.x / s.w, 'y', s.y / s.w))"
    return F.expr(f"aggregate(sequence(1, {rounds}), {mean}, (z, k) -> {fold})")


def pairs_of(embedding: str) -> str:
    """SQL for successive pairs of an array as points."""
    return f"transform(sequence(0, size({embedding}) div 2 - 1), i -> named_struct('x', cast({embedding}[2 * i] as double), 'y', cast({embedding}[2 * i + 1] as double)))"


def quantiles(values, levels: list[float]):
    """Linearly interpolated quantiles of an array column, as an array; no shuffle."""
    s, n = F.array_sort(values), F.size(values)

    def at(level: float):
        h = (n - 1) * F.lit(level)
        lo = F.floor(h).cast("int")
        a = F.get(s, lo)
        return a + (F.get(s, F.least(lo + 1, n - 1)) - a) * (h - lo)

    return F.array(*map(at, levels))


def region_calibration(forecasts: DataFrame, samples: str, tx, ty, levels: list[float]) -> DataFrame:
    """By level: share of targets inside the circle about the spatial median that holds that share of samples, and its mean radius."""
    # explode works the median out once a row, before its uses below
    about = lambda z: F.struct(F.hypot(tx - z["x"], ty - z["y"]).alias("r"), F.array_sort(F.transform(samples, lambda a: F.hypot(a["x"] - z["x"], a["y"] - z["y"]))).alias("far"))
    x = forecasts.select(F.explode(F.transform(F.array(spatial_median(samples)), about)).alias("g"))
    x = x.select("g.r", quantiles(F.col("g.far"), levels).alias("radius"))
    x = x.select("r", F.posexplode("radius").alias("i", "radius"))
    out = x.groupBy("i").agg(F.avg((F.col("r") <= F.col("radius")).cast("double")).alias("coverage"), F.avg("radius").alias("mean_radius"))
    return out.withColumn("level", F.get(F.array(*map(F.lit, levels)), F.col("i"))).drop("i")


def hex_cells(rings: int, edge: float) -> list[tuple[int, int, float, float]]:
    """(q, r, x, y) of the cells, q outer: 3 rings (rings + 1) + 1 of them."""
    span = range(-rings, rings + 1)
    return [(q, r, edge * 3**0.5 * (q + r / 2), edge * 1.5 * r) for q in span for r in span if abs(q + r) <= rings]


def hex_density(samples: str, rings: int, edge: float):
    """Class probabilities of a Gaussian kernel density over the cells, the outside last, as an array column; row by row.

    The bandwidth is the larger of the samples' mean deviation times M^(-1/6) and half an edge. A cell
    takes density times area, at most 1; above a sum of 1 all are divided by it.
    """
    cells = "array(" + ", ".join(f"named_struct('x', {x!r}d, 'y', {y!r}d)" for _, _, x, y in hex_cells(rings, edge)) + ")"
    area, p, n = 1.5 * 3**0.5 * edge * edge, samples, f"size({samples})"
    mean = lambda c: f"aggregate({p}, 0d, (s, a) -> s + a.{c}) / {n}"
    var = lambda c: f"aggregate({p}, 0d, (s, a) -> s + pow(a.{c} - {mean(c)}, 2)) / {n}"
    width = F.expr(f"greatest(sqrt(({var('x')} + {var('y')}) / 2) * pow({n}, -1d / 6), {edge / 2!r}d)")

    def of(h):
        raw = F.transform(F.expr(cells), lambda c: F.least(F.lit(1.0), F.aggregate(p, F.lit(0.0), lambda s, a: s + F.exp(-(F.pow(a["x"] - c["x"], 2) + F.pow(a["y"] - c["y"], 2)) / (2 * h * h))) / F.size(p) / (2 * F.pi() * h * h) * area))
        return raw

    # a one-element array binds the bandwidth and the total, so each is worked out once a row
    raw = F.flatten(F.transform(F.array(width), of))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    scaled = F.flatten(F.transform(F.array(F.struct(raw.alias("a"), F.greatest(total(raw), F.lit(1.0)).alias("t"))), lambda b: F.transform(b["a"], lambda v: v / b["t"])))
    return F.flatten(F.transform(F.array(scaled), lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - total(a))))))


def hex_scores(probs: str, truth: str, mix: float = 1e-4) -> dict[str, Column]:
    """Scores of a class probability array against the true class (0-based): nll, top1, top5, outside.

    Probabilities are mixed with a little of the uniform. Of equal classes the lower is ranked first.
    """
    p, t = F.col(probs), F.col(truth)
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    own = F.get(p, t)
    better = F.size(F.filter(p, lambda v, i: (v > own) | ((v == own) & (i < t))))
    nll = -F.log((1 - mix) * own / total + mix / F.size(p))
    return {"nll": nll, "top1": better < 1, "top5": better < 5, "outside": t == F.size(p) - 1}


def path(steps: DataFrame, window: list[str], step: str = "step") -> DataFrame:
    """cum_x, cum_y: place after each step dx, dy of a window."""
    w = Window.partitionBy(*window).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("cum_x", F.sum("dx").over(w)).withColumn("cum_y", F.sum("dy").over(w))


def climatology(pool: DataFrame, tests: DataFrame, ids: list[str], draws: int, least: int = 30, seed: str = "3") -> DataFrame:
    """Draws with replacement of training futures of a test window's hour (of all hours where it has under `least`), turned.

    pool: hour, day, key, fx, fy; tests: ids and hour. The draw and its rotation and mirror come from
    a digest of the ids, the number of the draw and the seed. Pools are numbered, not collected, so a draw is an equality join.
    """
    from trackloom.operators.folds import numbered

    by_hour = numbered(pool, ["hour"], F.col("day"), ["day", "key"]).drop("day", "key")
    every = numbered(pool.withColumn("hour", F.lit(-1)), ["hour"], F.col("day"), ["day", "key"]).drop("day", "key")
    sizes = by_hour.groupBy("hour").agg(F.max("n").alias("n")).unionByName(every.groupBy("hour").agg(F.max("n").alias("n")))  # 25 rows
    own = sizes.where((F.col("n") >= least) & (F.col("hour") >= 0))
    whole = sizes.where("hour = -1").select(F.col("n").alias("n_all"))
    x = tests.join(F.broadcast(own), "hour", "left").crossJoin(F.broadcast(whole))  # at most 24 rows and one
    x = x.withColumn("hour", F.when(F.col("n").isNull(), -1).otherwise(F.col("hour"))).withColumn("n", F.coalesce("n", "n_all")).drop("n_all")
    x = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws(":", *ids, "m", F.lit(seed)))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    x = x.withColumn("k", number(1, 12) % F.col("n")).withColumn("turn", number(13, 8) / 4294967296.0 * 2 * F.pi()).withColumn("flip", F.when(number(21, 1) < 8, 1.0).otherwise(-1.0)).drop("n")
    both = by_hour.unionByName(every).select("hour", "k", "fx", "fy")
    x = x.join(both, ["hour", "k"])
    c, s, fy = F.cos("turn"), F.sin("turn"), F.col("fy") * F.col("flip")
    return x.select(*ids, "m", (F.col("fx") * c - fy * s).alias("x"), (F.col("fx") * s + fy * c).alias("y"))

"""Fixes to trajectories: duplicates, intervals, gap and speed breaks, sliding windows, displacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo

ANIMAL = ("study_id", "individual_id")


def dedup_fixes(fixes: DataFrame, ordinal: str = "event_id") -> DataFrame:
    """One fix for each animal and time: the first in input order."""
    w = Window.partitionBy(*ANIMAL, "timestamp").orderBy(ordinal)
    return fixes.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def once(fixes: DataFrame, ordinal: str = "event_id") -> DataFrame:
    """dedup_fixes() in the order of an animal's fixes: what follows by time needs no further shuffle or sort."""
    w = Window.partitionBy(*ANIMAL).orderBy("timestamp", ordinal)
    return fixes.withColumn("__t", F.lag("timestamp").over(w)).where("__t is null or __t <> timestamp").drop("__t")


def histories(fixes: DataFrame, ordinal: str = "event_id") -> DataFrame:
    """All fixes of each animal over its segments, strictly ascending in time, with their 0-based place k."""
    return once(fixes, ordinal).withColumn("k", F.row_number().over(Window.partitionBy(*ANIMAL).orderBy("timestamp")) - 1)


def with_steps(fixes: DataFrame) -> DataFrame:
    """dt_s, step_m and speed_mps since the animal's fix before (null at its first)."""
    w = Window.partitionBy(*ANIMAL).orderBy("timestamp")
    lag = lambda c: F.lag(c).over(w)
    out = fixes.withColumn("dt_s", (F.unix_micros("timestamp") - F.unix_micros(lag("timestamp"))) / 1e6)
    out = out.withColumn("step_m", geo.step_metres(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")))
    return out.withColumn("speed_mps", F.try_divide("step_m", "dt_s"))


def segments(fixes: DataFrame, gap_s: float, max_speed: float | None = None) -> DataFrame:
    """seg: number of breaks so far. A step breaks if longer than gap_s or faster than max_speed; its fix starts the segment."""
    steps = with_steps(fixes)
    broken = F.col("dt_s") > gap_s
    if max_speed is not None:
        broken = broken | (F.coalesce(F.col("speed_mps"), F.lit(0.0)) > max_speed)
    w = Window.partitionBy(*ANIMAL).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("seg", F.sum(F.when(broken, 1).otherwise(0)).over(w))


def discard_short(segmented: DataFrame, least: int) -> DataFrame:
    """Segments of at least so many fixes."""
    return segmented.withColumn("n_fixes", F.count("*").over(Window.partitionBy(*ANIMAL, "seg"))).where(F.col("n_fixes") >= least)


def sliding_windows(segmented: DataFrame, length: int, horizon: int, stride: int = 1) -> DataFrame:
    """A row for each window of length + horizon successive fixes of a segment: start, window (array), t_origin."""
    n = length + horizon
    w = Window.partitionBy(*ANIMAL, "seg").orderBy("timestamp")
    at = segmented.withColumn("start", F.row_number().over(w) - 1)
    point = F.struct("timestamp", "lat", "lon")
    if stride == 1:
        out = at.withColumn("window", F.collect_list(point).over(w.rowsBetween(0, n - 1)))
    else:  # only windows that are kept: a fix goes to those that hold it
        first = F.greatest(F.ceil((F.col("start") - (n - 1)) / stride), F.lit(0))
        out = at.withColumn("start", F.explode(F.transform(F.sequence(first, F.floor(F.col("start") / stride)), lambda k: (k * stride).cast("int"))) if stride < n else F.when(F.col("start") % stride < n, F.col("start") - F.col("start") % stride))
        out = out.where("start is not null").groupBy(*ANIMAL, "seg", "start").agg(F.sort_array(F.collect_list(point)).alias("window"))
    return out.where(F.size("window") == n).select(*ANIMAL, "seg", "start", F.col("window")[length]["timestamp"].alias("t_target"), "window")


def elapsed(windows: DataFrame) -> DataFrame:
    """A row for each fix of a window: pos and the seconds since the window's first fix."""
    out = windows.select(*ANIMAL, "seg", "start", F.posexplode("window").alias("pos", "p"), F.col("window")[0]["timestamp"].alias("t0"))
    return out.select(*ANIMAL, "seg", "start", "pos", ((F.unix_micros("p.timestamp") - F.unix_micros("t0")) / 1e6).alias("elapsed_s"))


def rotated(steps: DataFrame, window: list[str], seed: str = "3", mirror: bool = True) -> DataFrame:
    """dx, dy turned by one random angle for each window, and mirrored (x to -x, first) in half of them; angles come from digests."""
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in window), F.lit(seed)))
    angle = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48) * 2 * F.pi()
    flip = F.when(F.conv(F.substring(digest, 13, 1), 16, 10).cast("int") < 8, -1.0).otherwise(1.0) if mirror else F.lit(1.0)
    x = steps.withColumn("__a", angle).withColumn("__x", F.col("dx") * flip)
    turned = {"dx": F.col("__x") * F.cos("__a") - F.col("dy") * F.sin("__a"), "dy": F.col("__x") * F.sin("__a") + F.col("dy") * F.cos("__a")}
    return x.withColumns(turned).drop("__a", "__x")


def displacements(windows: DataFrame, length: int) -> DataFrame:
    """A row for each step of a window: pos, dx, dy in the frame of the last observed fix; the first step is zero."""
    out = windows.withColumn("o", F.col("window")[length - 1]).select(*ANIMAL, "seg", "start", "t_target", "o", F.posexplode("window").alias("pos", "p"))
    x, y = geo.local_xy(F.col("p.lat"), F.col("p.lon"), F.col("o.lat"), F.col("o.lon"))
    w = Window.partitionBy(*ANIMAL, "seg", "start").orderBy("pos")
    out = out.withColumn("x", x).withColumn("y", y).withColumn("timestamp", F.col("p.timestamp"))
    return out.withColumn("dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn("dy", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))).drop("o", "p")


def kth_smallest(values: DataFrame, column: str, k: int) -> int:
    """The k-th smallest (from 1) of a column of longs, by counting 16 bits at a time: no state grows with the distinct values."""
    prefix = None
    for shift in (48, 32, 16, 0):
        part = values if prefix is None else values.where(F.shiftright(column, shift + 16) == prefix)
        for r in sorted(part.groupBy(F.shiftright(column, shift).alias("b")).agg(F.count("*").alias("n")).collect()):  # 65,536 rows at most
            if r["n"] >= k:
                prefix = r["b"]
                break
            k -= r["n"]
    return prefix


def sampling_profile(fixes: DataFrame) -> DataFrame:
    """Median of positive intervals in hours, and the share within a tenth of it. No interval, no row."""
    us = with_steps(fixes).where("dt_s > 0").select(F.round(F.col("dt_s") * 1e6).cast("long").alias("us"))
    n = us.count()
    if not n:
        return us.sparkSession.createDataFrame([], "median_h double, regular_share double, n long")
    a, b = (kth_smallest(us, "us", k) for k in ((n + 1) // 2, n // 2 + 1))
    h, median = F.col("us") / 3.6e9, F.lit((a + b) / 2 / 3.6e9)
    near = h.between(0.9 * median, 1.1 * median).cast("double")
    return us.agg(F.avg(near).alias("regular_share"), F.count("*").alias("n")).select(median.alias("median_h"), "regular_share", "n")


def modal_interval(fixes: DataFrame, bins: int = 200, most_h: float = 72.0) -> DataFrame:
    """Middle of the fullest of equal-width bins over positive intervals up to most_h; the first of equals."""
    h = with_steps(fixes).select((F.col("dt_s") / 3600).alias("h")).where((F.col("h") > 0) & (F.col("h") <= most_h))
    edge = h.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    x = h.crossJoin(F.broadcast(edge)).withColumn("bin", F.least(F.floor((F.col("h") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    x = x.groupBy("lo", "hi", "bin").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(1)
    return x.select("bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("modal_h"))


def window_scaling(profiles: DataFrame) -> DataFrame:
    """Window sizes for a sampling interval dt_h: input, horizon and gap multiplier."""
    dt = F.greatest(F.col("dt_h"), F.lit(0.25))
    rint = lambda c: F.rint(c).cast("long")
    return profiles.select(
        "dt_h",
        F.least(F.lit(128), F.greatest(F.lit(2), rint(24 / dt))).alias("input_len"),
        F.least(F.lit(64), F.greatest(F.lit(1), rint(12 / dt))).alias("horizon"),
        (F.greatest(F.lit(3.0), 1 / dt) * dt / F.col("dt_h")).alias("gap_multiplier"),
    )


def tail_cuts(fixes: DataFrame, share: float) -> DataFrame:
    """Per animal, the time from which its last `share` of fixes is validation."""
    w = Window.partitionBy(*ANIMAL).orderBy("timestamp")
    n = F.count("*").over(Window.partitionBy(*ANIMAL))
    x = fixes.withColumn("k", F.row_number().over(w) - 1).withColumn("n", n)
    return x.where(F.col("k") == F.least(F.col("n") - 1, F.floor((1 - share) * F.col("n")))).select(*ANIMAL, F.col("timestamp").alias("val_cut"), "n")


def dealt(units: DataFrame, name, val: float, test: float, seed: str) -> DataFrame:
    """Units of each study dealt to train, val and test (split) in the order of a seeded digest of their name; under 3 units: train."""
    by = Window.partitionBy("study_id")
    a = units.withColumn("__k", F.row_number().over(by.orderBy(F.sha2(F.concat(name, F.lit(":" + seed)), 256), name))).withColumn("__n", F.count("*").over(by))
    n = F.col("__n")
    a = a.withColumn("__val", F.greatest(F.lit(1), F.least(F.bround(n * val), n - 2)))
    a = a.withColumn("__test", F.greatest(F.lit(1), F.least(F.bround(n * test), n - F.col("__val") - 1)))
    split = F.when(n < 3, "train").when(F.col("__k") <= F.col("__val"), "val").when(F.col("__k") <= F.col("__val") + F.col("__test"), "test").otherwise("train")
    return a.withColumn("split", split).drop("__k", "__n", "__val", "__test")


def split_animals(fixes: DataFrame, val: float, test: float, seed: str = "7") -> DataFrame:
    """Animals dealt to splits, so that no animal is in two."""
    return dealt(fixes.select(*ANIMAL).distinct(), F.col("individual_id"), val, test, seed)


def split_segments(segmented: DataFrame, val: float, test: float, seed: str = "7") -> DataFrame:
    """Segments dealt to splits on their own: an animal may be in several, so scores on these splits leak."""
    units = segmented.select(*ANIMAL, "seg").distinct()
    return dealt(units, F.concat_ws("/", "individual_id", F.col("seg").cast("string")), val, test, seed)


def follow(segmented: DataFrame, split: DataFrame) -> DataFrame:
    """Every fix with the split of its animal; animals without one go."""
    return segmented.join(split.select(*ANIMAL, "split"), list(ANIMAL))


def overlaps(members: DataFrame) -> DataFrame:
    """One row: animals that stand in both of two splits, for each two. All 0 where splits are disjoint."""
    has = [F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}_{b}")
    return members.groupBy(*ANIMAL).agg(*has).agg(both("train", "val"), both("train", "test"), both("val", "test"))


def check_disjoint(members: DataFrame, tail: bool = False) -> None:
    """Raises where an animal is in two splits; with validation by tail, train and val share their animals."""
    found = {k: n for k, n in overlaps(members).first().asDict().items() if n and not (tail and k == "train_val")}
    if found:
        raise ValueError(f"animals in two splits: {found}")


def profile(fixes: DataFrame) -> DataFrame:
    """Counts of a dataset by study: animals, fixes, span, long gaps."""
    s = with_steps(fixes)
    over = lambda h: F.sum(F.when(F.col("dt_s") > h * 3600, 1).otherwise(0)).alias(f"gaps_{h}h")
    return s.groupBy("study_id").agg(F.count("*").alias("fixes"), F.countDistinct("individual_id").alias("animals"), F.min("timestamp").cast("string").alias("first"), F.max("timestamp").cast("string").alias("last"), over(3), over(6), over(24))


def home_range(fixes: DataFrame, days: int, near_m: float) -> DataFrame:
    """Over the days up to each fix: number of fixes, centre relative to the fix, share of the span covered."""
    w = Window.partitionBy(*ANIMAL).orderBy(F.col("t")).rangeBetween(-days * 86400, 0)
    x = fixes.withColumn("t", F.unix_seconds("timestamp"))
    x = x.withColumn("n", F.count("*").over(w)).withColumn("mlat", F.avg("lat").over(w)).withColumn("mlon", F.avg("lon").over(w)).withColumn("t0", F.min("t").over(w))
    cx, cy = geo.local_xy(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon"))
    dist = F.hypot(cx, cy)
    return x.select("event_id", "n", cx.alias("centre_dx"), cy.alias("centre_dy"), (dist <= near_m).alias("near"), F.least(F.lit(1.0), (F.col("t") - F.col("t0")) / (days * 86400.0)).alias("history"))


def engineered(steps: DataFrame, length: int) -> DataFrame:
    """Inputs of displacements(): step length and turn, both of the row before (the first repeats itself), and the cyclic hour and day of year of its first target."""
    w = Window.partitionBy(*ANIMAL, "seg", "start").orderBy("pos")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    x = steps.where(F.col("pos") < length).withColumn("len", F.hypot("dx", "dy")).withColumn("heading", F.atan2("dy", "dx"))
    x = x.withColumn("bend", F.coalesce(geo.wrap_angle(F.col("heading") - F.lag("heading").over(w)), F.lit(0.0)))
    x = x.withColumn("step_length", before("len")).withColumn("turn", before("bend")).drop("len", "heading", "bend")
    hour, day = 2 * F.pi() * (F.hour("t_target") + F.minute("t_target") / 60) / 24, 2 * F.pi() * F.dayofyear("t_target") / 365.25
    return x.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)})


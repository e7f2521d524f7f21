"""Rasters as long pixel tables: composers, neighbourhoods, terrain, rates, distances.

A pixel sends its value to its neighbours and one aggregation by target pixel gathers them, so a
neighbourhood costs one shuffle with map-side partial sums and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXEL = ("px_row", "px_col")


def composite(obs: DataFrame, keys: tuple[str, ...], value: str, t: str) -> DataFrame:
    """By key: median, last (on top) and first of the values there are, number of valid observations."""
    on = F.col(value).isNotNull()
    return obs.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.max_by(F.when(on, F.col(value)), F.when(on, F.col(t))).alias("mosaic"),
        F.min_by(F.when(on, F.col(value)), F.when(on, F.col(t))).alias("first"), F.count(value).alias("n_valid"),
    )


def padded(requested: DataFrame, composed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each requested key; null bands where nothing was observed."""
    return requested.join(composed, list(keys), "left")


def class_fraction(obs: DataFrame, keys: tuple[str, ...], value: str, classes: tuple) -> DataFrame:
    """Share of the valid observations whose class is among `classes`; null without any."""
    hit = F.when(F.col(value).isNotNull(), F.col(value).isin(*classes).cast("double"))
    return obs.groupBy(*keys).agg(F.avg(hit).alias("fraction"), F.count(value).alias("n_valid"))


def _offsets(radius: float) -> str:
    k = int(radius)
    near = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= radius * radius]
    return "array(" + ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in near) + ")"


def _spread(pixels: DataFrame, value: str, radius: float) -> DataFrame:
    """Each value at each pixel that has it in its circle; a, b: where it comes from."""
    x = pixels.where(F.col(value).isNotNull()).select(*PIXEL, F.col(value).alias("v"), F.explode(F.expr(_offsets(radius))).alias("o"))
    return x.select((F.col("px_row") - F.col("o.a")).alias("px_row"), (F.col("px_col") - F.col("o.b")).alias("px_col"), F.col("o.a").alias("a"), F.col("o.b").alias("b"), "v")


def focal(pixels: DataFrame, value: str, radius: float) -> DataFrame:
    """Of the circle about each pixel with a value: position index, ruggedness, roughness, mean and mode."""
    v, mid = F.col("v"), (F.col("a") == 0) & (F.col("b") == 0)
    x = _spread(pixels, value, radius).groupBy(*PIXEL).agg(
        F.max(F.when(mid, v)).alias("v"), F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("roughness"),
        F.mode("v", True).alias("mode"), F.collect_list("v").alias("all"),
    )
    x = x.where("v is not null")
    tri = F.aggregate("all", F.lit(0.0), lambda s, u: s + F.abs(u - F.col("mean"))) / F.size("all")
    return x.select(*PIXEL, (F.col("v") - F.col("mean")).alias("tpi"), tri.alias("tri"), "roughness", "mean", "mode")


def terrain(pixels: DataFrame, value: str, cell_m: float) -> DataFrame:
    """Slope and aspect in degrees by Horn's 3 x 3 differences; pixels that lack a neighbour have none."""
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    weight = F.when((a == 0) | (b == 0), 2.0).otherwise(1.0)
    x = _spread(pixels, value, 1.5).groupBy(*PIXEL).agg(
        F.count("*").alias("n"), (F.sum(v * b * weight) / (8 * cell_m)).alias("gx"), (F.sum(v * a * weight) / (8 * cell_m)).alias("gy")
    )
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))), F.lit(360.0))
    return x.where("n = 9").select(*PIXEL, F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"), aspect.alias("aspect"), "gx", "gy")


def band_rate(composed: DataFrame, keys: tuple[str, ...], window: str, value: str, lag: int, k: int) -> DataFrame:
    """Change of a band a day against the window `lag` before, of 2k days each; null where that is missing."""
    if lag < 1:
        raise ValueError("lag must be at least 1")
    before = composed.select(*keys, (F.col(window) + lag).alias(window), F.col(value).alias("__before"))
    x = composed.join(before, [*keys, window], "left")
    return x.withColumn("rate", (F.col(value) - F.col("__before")) / (2.0 * k * lag)).drop("__before")


def distance_to(pixels: DataFrame, value: str, least: float, radius: int) -> DataFrame:
    """Distance in pixels to the nearest pixel of at least `least` within the radius, else null.

    Sources go to the nine blocks of side `radius` about them and meet pixels by an equality join of
    blocks. A source whose eight neighbours are sources too can't be nearest but to itself, so only the rims of
    source areas are sent.
    """
    block = lambda c: F.floor(F.col(c) / radius)
    source = pixels.select(*PIXEL, (F.coalesce(F.col(value), F.lit(float("-inf"))) >= least).alias("is"))
    inner = _spread(source.where("is").withColumn("one", F.lit(1.0)), "one", 1.5).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    rim = source.where("is").join(inner.where("n < 9"), list(PIXEL), "left_semi")
    step = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    sent = rim.select(F.col("px_row").alias("r"), F.col("px_col").alias("c")).withColumn("a", step).withColumn("b", step)
    sent = sent.select("r", "c", (block("r") + F.col("a")).alias("br"), (block("c") + F.col("b")).alias("bc"))
    x = source.withColumn("br", block("px_row")).withColumn("bc", block("px_col")).join(sent, ["br", "bc"], "left")
    d = F.hypot(F.col("px_row") - F.col("r"), F.col("px_col") - F.col("c"))
    near = x.groupBy(*PIXEL, "is").agg(F.min(F.when(d <= radius, d)).alias("d"))
    return near.select(*PIXEL, F.when(F.col("is"), 0.0).otherwise(F.col("d")).alias("distance"))


def footprint(points: DataFrame, pad: float) -> DataFrame:
    """One row: the box of the points, padded."""
    return points.agg((F.min("lon") - pad).alias("west"), (F.max("lon") + pad).alias("east"), (F.min("lat") - pad).alias("south"), (F.max("lat") + pad).alias("north"))


def within(scenes: DataFrame, box: DataFrame) -> DataFrame:
    """Scenes whose point is in the box of footprint(); the box is one row."""
    b = F.broadcast(box)
    return scenes.join(b, F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).drop("west", "east", "south", "north")


def cadence_window(ts, ref, cadence: str, k: int = 8, last_year: int = 9999):
    """True where an observation's time belongs to the image for a reference time."""
    span = {"monthly": "month", "daily": "day", "hourly": "hour"}
    if cadence == "static":
        return F.lit(True)
    if cadence == "annual":
        return F.year(ts) == F.least(F.year(ref), F.lit(last_year))
    if cadence == "composite":
        d = F.datediff(ts, ref)
        return (d >= -k) & (d < k)
    return F.date_trunc(span[cadence], ts) == F.date_trunc(span[cadence], ref)

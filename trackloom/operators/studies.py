"""Study tables: seasons, pooled means, pivots, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pooled(runs: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted means; rows without a value don't count."""
    on = F.col(value).isNotNull()
    return runs.groupBy(by).agg(F.try_divide(F.sum(F.when(on, F.col(value) * F.col(weight))), F.sum(F.when(on, F.col(weight)))).alias("pooled"), F.count(value).alias("n"))


def paired(runs: DataFrame, unit: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """Mean of both arms and their difference, for units that have both."""
    p = runs.groupBy(unit).pivot(arm, [a, b]).agg(F.avg(value))
    return p.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(unit, F.col(a).alias("a"), F.col(b).alias("b"), (F.col(a) - F.col(b)).alias("diff"))


def arm_summary(runs: DataFrame, arm: str, value: str) -> DataFrame:
    """Mean and sample deviation by arm; 0 for one run."""
    return runs.groupBy(arm).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def ranking(runs: DataFrame, by: str, arm: str, value: str) -> DataFrame:
    """Arms of each group by their least value, as one string."""
    best = runs.groupBy(by, arm).agg(F.min(value).alias("v"))
    return best.groupBy(by).agg(F.concat_ws(" > ", F.transform(F.array_sort(F.collect_list(F.struct("v", arm))), lambda x: x[arm])).alias("ranking"))


def with_totals(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Mean by group, and over all as 'all'."""
    return scores.rollup(by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping(by).alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col(by)).alias(by), "mean", "n")


#: Clusters whose sums a broadcast may hold.
BROADCAST_CLUSTERS = 1_000_000


def resampled(clusters: DataFrame, draws: int, seed: str, sums: tuple[str, ...]) -> DataFrame:
    """i and the sums of the clusters that resample i takes, from clusters numbered k of n.

    Draw j of resample i takes the number that a digest of i, j and the seed gives, so clusters aren't
    joined with each other. Up to BROADCAST_CLUSTERS, which are counted, draws meet the sums in place
    and only sums are shuffled; beyond, drawn numbers are counted first.
    """
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "i", "k", F.lit(seed))), 1, 12), 16, 10).cast("long") % F.col("n")
    spread = clusters.select("k", "n").repartition(clusters.sparkSession.sparkContext.defaultParallelism, "k")  # a few rows become many draws
    drawn = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("i", pick.alias("k"))
    held = clusters.select("k", *sums)
    if clusters.count() <= BROADCAST_CLUSTERS:
        return drawn.join(F.broadcast(held), "k").groupBy("i").agg(*(F.sum(c).alias(c) for c in sums))
    times = drawn.groupBy("i", "k").agg(F.count("*").alias("times"))
    return times.join(held, "k").groupBy("i").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in sums))


def numbered_clusters(c: DataFrame, cluster: str) -> DataFrame:
    from trackloom.operators.folds import numbered

    return numbered(c.withColumn("all", F.lit(0)), ["all"], F.floor(F.col(cluster) / 1024), [cluster]).drop("all")


def bootstrap(scores: DataFrame, cluster: str, value: str, draws: int, seed: str = "5") -> DataFrame:
    """Cluster bootstrap of a mean: the 2.5 and 97.5 percentiles of ratios of sums over clusters drawn with replacement."""
    c = numbered_clusters(scores.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("m")), cluster)
    ratios = resampled(c, draws, seed, ("s", "m")).select((F.col("s") / F.greatest("m", F.lit(1))).alias("r"))
    return ratios.agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"), F.count("*").alias("draws"))


def pivot(runs: DataFrame, unit: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """Mean by unit, a column for each arm, and the least of them."""
    p = runs.groupBy(unit).pivot(arm, arms).agg(F.avg(value))
    return p.withColumn("best", F.least(*arms) if len(arms) > 1 else F.col(arms[0]))


def flags(runs: DataFrame, ratio: float = 0.97, late: float = 0.9) -> DataFrame:
    """collapsed: no better than standing still, in a model without samples; improving: the best epoch is among the last and nothing stopped it."""
    collapsed = (F.try_divide("ade", "ade_cp") >= ratio) & ~F.coalesce("probabilistic", F.lit(False))
    improving = (F.col("best_epoch") >= late * F.col("max_epochs") - 1) & ~F.col("stopped_early").eqNullSafe(True)
    return runs.withColumn("collapsed", F.coalesce(collapsed, F.lit(False))).withColumn("improving", F.coalesce(improving, F.lit(False)))


def sign_counts(scores: DataFrame, fold: str, by: str, delta: str) -> DataFrame:
    """Of each group: mean difference, folds, and folds whose mean is below zero."""
    f = scores.groupBy(by, fold).agg(F.avg(delta).alias("m"), F.sum(delta).alias("s"), F.count(delta).alias("n"))
    return f.groupBy(by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.count("*").alias("folds"), F.sum(F.when(F.col("m") < 0, 1).otherwise(0)).alias("negative_folds"))


def contrast(scores: DataFrame, cluster: str, season: str, value: str, a: str, b: str, draws: int, seed: str = "5") -> DataFrame:
    """Bootstrap of the difference of two seasons' means, clusters drawn jointly: mean, 2.5 and 97.5 percentiles."""
    one = lambda s: [F.sum(F.when(F.col(season) == s, F.col(value))), F.count(F.when(F.col(season) == s, F.col(value)))]
    (sa, na), (sb, nb) = one(a), one(b)
    c = scores.groupBy(cluster).agg(F.coalesce(sa, F.lit(0.0)).alias("sa"), na.alias("na"), F.coalesce(sb, F.lit(0.0)).alias("sb"), nb.alias("nb"))
    c = numbered_clusters(c, cluster)
    sums = resampled(c, draws, seed, ("sa", "na", "sb", "nb"))
    r = sums.select((F.col("sa") / F.greatest("na", F.lit(1)) - F.col("sb") / F.greatest("nb", F.lit(1))).alias("r"))
    return r.agg(F.avg("r").alias("mean"), F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"), F.count("*").alias("draws"))


def decisions(seasons: DataFrame, by: str, least_folds: int = 4) -> DataFrame:
    """supported: the interval lies below zero and enough folds are negative. Needs hi and negative_folds."""
    return seasons.withColumn("supported", (F.col("hi") < 0) & (F.col("negative_folds") >= least_folds)).select(by, "hi", "negative_folds", "supported")


def pooled_curve(runs: DataFrame, curve: str, weight: str) -> DataFrame:
    """Weighted mean at each level of JSON maps level -> coverage."""
    x = runs.select(F.explode(F.from_json(curve, "map<string,double>")).alias("level", "v"), F.col(weight).alias("w")).where("v is not null")
    return x.groupBy(F.col("level").cast("double").alias("level")).agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("coverage"))


def best_of(trials: DataFrame, by: list[str], trial: str, value: str, ordinal: str) -> DataFrame:
    """The trial of least value in each group; the first of equals. Trials without a value don't count."""
    return trials.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(trial, F.struct(value, ordinal)).alias("trial"), F.min(value).alias("value"))


def families(trials: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean and sample deviation over seeds (0 for one), and whether the deviation is too large for a clear difference."""
    x = trials.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))
    return x.withColumn("unclear", F.col("sd") > share * F.abs("mean"))


def top_weights(weights: DataFrame, name: str, weight: str, k: int = 15) -> DataFrame:
    """The k covariates of largest mean weight, with the mean and share where observed."""
    on = F.col("observed")
    x = weights.groupBy(name).agg(F.avg(weight).alias("mean"), F.avg(F.when(on, F.col(weight))).alias("mean_observed"), F.avg(on.cast("double")).alias("observed"))
    return x.orderBy(F.desc("mean"), name).limit(k)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of small axes (a trial grid), with the digest of their values as id."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out.withColumn("trial_id", F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(out.columns))), 256), 1, 16))


def nearest_trial(trials: DataFrame, by: list[str], value: str, distance, ordinal: str) -> DataFrame:
    """Of each group, the 1-based rank by value of the trial at the least distance."""
    w = Window.partitionBy(*by).orderBy(value, ordinal)
    x = trials.withColumn("rank", F.row_number().over(w)).withColumn("__d", distance)
    return x.groupBy(*by).agg(F.min_by("rank", F.struct("__d", ordinal)).alias("rank"))


def early_stopping(epochs: DataFrame, run: str, epoch: str, loss: str, patience: int, min_delta: float = 1e-4) -> DataFrame:
    """By run: its best epoch and where training stops, once `patience` epochs pass without a gain of over min_delta.

    The best so far moves only by such gains, so it is folded over a run's epochs, which are few.
    """
    seq = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(loss).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(s, x):
        gain = s["best"].isNull() | (x["v"] < s["best"] - min_delta)
        bad = F.when(gain, 0).otherwise(s["bad"] + 1)
        new = F.struct(F.when(gain, x["v"]).otherwise(s["best"]).alias("best"), F.when(gain, x["e"]).otherwise(s["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, x["e"]).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    x = epochs.groupBy(run).agg(seq.alias("s")).withColumn("r", F.aggregate("s", start, step))
    return x.select(run, F.col("r.at").alias("best_epoch"), F.col("r.best").alias("best"), F.col("r.stop").alias("stop_epoch"))

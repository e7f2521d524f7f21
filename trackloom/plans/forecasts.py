"""Queries on windows, folds, memory, forecast scores and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import bands, geo, projection
from trackloom.operators import covariates as cov
from trackloom.operators import folds, memory, rasters, scoring, studies, tracks
from trackloom.plans.catalogue import DISP, EMB, FIXES, SNAP, WINS, H, L, R, fixes, r6, snapped, windows
from trackloom.plans.registry import ORACLE_SQL, query, table

WIN = ["study_id", "individual_id", "seg", "start"]


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.expr(scoring.pairs_of("embedding")).alias("p"))


@query("window_features", f"""WITH {DISP}, h AS (SELECT *, max(CASE WHEN pos = {L} THEN timestamp END) OVER (PARTITION BY study_id, individual_id, seg, start) AS t, sqrt(dx * dx + dy * dy) AS len, atan2(dy, dx) AS heading FROM disp),
i AS (SELECT *, heading - lag(heading) OVER w + pi() AS a FROM h WHERE pos < {L} WINDOW w AS (PARTITION BY study_id, individual_id, seg, start ORDER BY pos)),
b AS (SELECT *, coalesce(((a % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi(), 0) AS bend FROM i)
SELECT individual_id, seg, start, pos, round(coalesce(lag(len) OVER w, len), 3) AS step_length, round(cos(coalesce(lag(bend) OVER w, bend)), 5) AS turn_cos, round(abs(sin(coalesce(lag(bend) OVER w, bend))), 5) AS turn_sin,
round(sin(2 * pi() * (hour(t) + minute(t) / 60) / 24), 5) AS hour_sin, round(cos(2 * pi() * dayofyear(t) / 365.25), 5) AS day_cos FROM b WINDOW w AS (PARTITION BY study_id, individual_id, seg, start ORDER BY pos)""")
def _(spark, d):
    x = tracks.engineered(tracks.displacements(windows(spark, d), L), L)
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), F.round("step_length", 3).alias("step_length"), F.round(F.cos("turn"), 5).alias("turn_cos"), F.round(F.abs(F.sin("turn")), 5).alias("turn_sin"), F.round("hour_sin", 5).alias("hour_sin"), F.round("day_cos", 5).alias("day_cos"))


@query("cumulative_path", f"WITH {DISP} SELECT individual_id, seg, start, pos, round(sum(dx) OVER w, 3) AS cum_x, round(sum(dy) OVER w, 3) AS cum_y FROM disp WHERE pos >= {L} WINDOW w AS (PARTITION BY study_id, individual_id, seg, start ORDER BY pos)")
def _(spark, d):
    x = scoring.path(tracks.displacements(windows(spark, d), L).where(F.col("pos") >= L), WIN, "pos")
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), F.round("cum_x", 3).alias("cum_x"), F.round("cum_y", 3).alias("cum_y"))


@query("haversine_ade", f"WITH {WINS}, o AS (SELECT study_id, individual_id, seg, start, lat AS lat0, lon AS lon0 FROM wins WHERE pos = {L - 1}) SELECT pos, round(avg(2 * {R} * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))), 4) AS ade FROM wins JOIN o USING (study_id, individual_id, seg, start) WHERE pos >= {L} GROUP BY pos")
def _(spark, d):
    x = windows(spark, d).select(F.col("window")[L - 1].alias("o"), F.posexplode(F.slice("window", L + 1, H)).alias("pos", "p"))
    return x.groupBy((F.col("pos") + L).cast("long").alias("pos")).agg(F.round(F.avg(geo.haversine(F.col("o.lat"), F.col("o.lon"), F.col("p.lat"), F.col("p.lon"))), 4).alias("ade"))


ANIMALS = f"{FIXES}, animals AS (SELECT study_id, individual_id, count(*) AS n FROM fixes GROUP BY 1, 2)"


@query("kfold_balanced", f"""WITH RECURSIVE {ANIMALS},
o AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY n DESC, sha256(individual_id || ':7'), individual_id) AS k FROM animals),
deal AS (SELECT study_id, CAST(0 AS BIGINT) AS k, [0, 0, 0, 0, 0]::BIGINT[] AS t, 0 AS fold FROM (SELECT DISTINCT study_id FROM o)
  UNION ALL SELECT o.study_id, o.k, list_transform([1, 2, 3, 4, 5], lambda i: deal.t[i] + CASE WHEN i = list_position(deal.t, list_min(deal.t)) THEN o.n ELSE 0 END)::BIGINT[], list_position(deal.t, list_min(deal.t)) FROM deal JOIN o ON o.study_id = deal.study_id AND o.k = deal.k + 1)
SELECT o.study_id, individual_id, n, CAST(fold - 1 AS INT) AS fold, CASE WHEN fold - 1 = 1 THEN 'test' WHEN fold - 1 = 2 THEN 'val' ELSE 'train' END AS role FROM o JOIN deal ON o.study_id = deal.study_id AND o.k = deal.k""")
def _(spark, d):
    return folds.fold_roles(folds.balanced_folds(fixes(spark, d).groupBy("study_id", "individual_id").agg(F.count("*").alias("n")), 5), 1, 5)


@query("tail_roles", f"WITH {FIXES}, k AS (SELECT *, row_number() OVER (PARTITION BY study_id, individual_id ORDER BY timestamp) - 1 AS k, count(*) OVER (PARTITION BY study_id, individual_id) AS n FROM fixes), c AS (SELECT individual_id, timestamp AS cut FROM k WHERE k = least(n - 1, CAST(floor((1 - 0.15) * n) AS BIGINT))) SELECT event_id, CASE WHEN timestamp < cut THEN 'train' ELSE 'val' END AS role FROM fixes JOIN c USING (individual_id)")
def _(spark, d):
    x = fixes(spark, d)
    return x.join(tracks.tail_cuts(x, 0.15).drop("n"), ["study_id", "individual_id"]).select("event_id", F.when(F.col("timestamp") < F.col("val_cut"), "train").otherwise("val").alias("role"))


@query("even_subsample", "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), i AS (SELECT DISTINCT (i * (n - 1)) // 99 AS k FROM range(100) r(i), (SELECT count(*) AS n FROM orders)) SELECT o_orderkey, k FROM k JOIN i USING (k)")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.lit(0).alias("all"))
    return folds.even_subsample(folds.numbered(x, ["all"], F.floor(F.col("o_orderkey") / 4096), ["o_orderkey"]), 100).select("o_orderkey", "k")


@query("chunk_packing", f"""WITH RECURSIVE {SNAP}, b AS (SELECT px_col % 3 AS zone, CAST(t0 AS VARCHAR) AS bucket, min(t0) AS t0, count(*) AS n FROM snap GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY t0, bucket) AS k FROM b),
pack AS (SELECT zone, k, n, 0 AS start, n AS total, 1 AS names, n > 150 AS big, 0::BIGINT AS chunk, ((n + 149) // 150)::BIGINT AS pieces FROM o WHERE k = 1
  UNION ALL SELECT zone, k, n, 0, CASE WHEN fresh THEN n ELSE total + n END, CASE WHEN fresh THEN 1 ELSE names + 1 END, big2, CASE WHEN fresh THEN chunk + CASE WHEN big THEN pieces ELSE 1 END ELSE chunk END, ((n + 149) // 150)::BIGINT
  FROM (SELECT o.zone, o.k, o.n, p.total, p.names, p.chunk, p.big, p.pieces, o.n > 150 AS big2, p.big OR o.n > 150 OR p.total + o.n > 150 OR p.names >= 4 AS fresh FROM pack p JOIN o ON o.zone = p.zone AND o.k = p.k + 1)),
m AS (SELECT pack.*, bucket FROM pack JOIN o USING (zone, k))
SELECT zone, chunk, CASE WHEN count(*) = 1 THEN min(bucket) ELSE min(bucket) || '..' || max(bucket) END AS label, CAST(sum(n) AS BIGINT) AS n_keys, count(*) AS n_buckets FROM m WHERE NOT big GROUP BY zone, chunk
UNION ALL SELECT zone, chunk + j, bucket, least(150, n - 150 * j), 1 FROM m, range(1000) r(j) WHERE big AND j < pieces""")
def _(spark, d):
    return folds.pack_chunks(snapped(spark, d).select((F.col("px_col") % 3).alias("zone"), F.col("t0").cast("string").alias("bucket"), "t0"), 150, 4)


@query("memory_step", f"""WITH {FIXES}, t AS (SELECT *, epoch_us(timestamp) // 1000000 AS t FROM fixes),
q AS (SELECT t.event_id, t.study_id, t.individual_id, t.t AS t_last, lat AS lat0, lon AS lon0, k, d, t.t + k * 21600 - d * 86400 AS q FROM t, range(1, 4) a(k), range(1, 6) b(d)),
n AS (SELECT q.event_id, k, d, arg_min(({R} * radians(t.lon - lon0) * cos(radians(lat0)), {R} * radians(t.lat - lat0)), (abs(t.t - q), t.t)) AS p FROM q JOIN t ON t.individual_id = q.individual_id AND t.t BETWEEN q - 10800 AND q + 10800 AND t.t <= t_last AND q <= t_last GROUP BY q.event_id, k, d),
c AS (SELECT q.event_id, q.k, q.d, greatest(-25000, least(25000, p[1])) AS x, greatest(-25000, least(25000, p[2])) AS y, p IS NOT NULL AS ok FROM q LEFT JOIN n ON n.event_id = q.event_id AND n.k = q.k AND n.d = q.d),
u AS (SELECT event_id, k, d, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM c)
SELECT event_id, k, round(coalesce(max(CASE WHEN d = 1 THEN x END), 0), 3) AS d1_dx, round(coalesce(max(CASE WHEN d = 1 THEN y END), 0), 3) AS d1_dy, max(CASE WHEN d = 1 THEN CASE WHEN x IS NULL THEN 0 ELSE 1 END END) AS d1_avail, round(coalesce(avg(x), 0), 3) AS mean_dx, round(coalesce(avg(y), 0), 3) AS mean_dy, round(count(x) / 5, 6) AS frac, round(sqrt(coalesce(var_pop(x), 0) + coalesce(var_pop(y), 0)), 3) AS spread FROM u GROUP BY event_id, k""")
def _(spark, d):
    x = fixes(spark, d).withColumn("t", F.unix_seconds("timestamp"))
    o = x.select("event_id", "study_id", "individual_id", F.col("t").alias("t_last"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    x = memory.memory_steps(o, x, 3, 21600, 5, ordinal="event_id").withColumn("k", F.col("k").cast("long"))
    return rounded(rounded(x, 3, "d1_dx", "d1_dy", "mean_dx", "mean_dy", "spread"), 6, "frac")


CHANGES = f"{DISP}, v AS (SELECT study_id, individual_id, seg, start, pos, CASE WHEN (start + pos) % 5 <> 0 THEN x END AS v FROM disp WHERE pos < {L}), g AS (SELECT *, v - avg(v) OVER w AS a, v - lag(v) OVER (w ORDER BY pos) AS s FROM v WINDOW w AS (PARTITION BY study_id, individual_id, seg, start))"


@query("covariate_changes", f"WITH {CHANGES} SELECT individual_id, seg, start, pos, round(coalesce(a, 0), 3) AS anomaly, round(coalesce(s, 0), 3) AS step_change, a IS NULL AS anomaly_missing, s IS NULL AS step_missing FROM g")
def _(spark, d):
    x = tracks.displacements(windows(spark, d), L).where(F.col("pos") < L).withColumn("v", F.when((F.col("start") + F.col("pos")) % 5 != 0, F.col("x")))
    x = cov.changes(x, WIN, "pos", "v")
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), F.round("anomaly", 3).alias("anomaly"), F.round("step_change", 3).alias("step_change"), "anomaly_missing", "step_missing")


@query("climatology", f"""WITH {DISP}, w AS (SELECT study_id, individual_id, seg, start, max(CASE WHEN pos = {L + H - 1} THEN x END) AS fx, max(CASE WHEN pos = {L + H - 1} THEN y END) AS fy, max(CASE WHEN pos = {L} THEN timestamp END) AS t FROM disp GROUP BY ALL),
pool AS (SELECT hour(t) AS hour, floor(epoch_us(t) / 8.64e10) AS day, study_id || individual_id || ':' || seg || ':' || start AS key, fx, fy FROM w WHERE study_id <> 'study_0'),
b AS (SELECT hour, row_number() OVER (PARTITION BY hour ORDER BY day, key) - 1 AS k, count(*) OVER (PARTITION BY hour) AS n, fx, fy FROM pool UNION ALL SELECT -1, row_number() OVER (ORDER BY day, key) - 1, count(*) OVER (), fx, fy FROM pool),
s AS (SELECT hour, max(n) AS n FROM b GROUP BY hour),
q AS (SELECT study_id || individual_id || ':' || seg || ':' || start AS win, CASE WHEN s.n >= 30 THEN w.h ELSE -1 END AS hour, CASE WHEN s.n >= 30 THEN s.n ELSE (SELECT n FROM s WHERE hour = -1) END AS n FROM (SELECT *, hour(t) AS h FROM w WHERE study_id = 'study_0') w LEFT JOIN s ON s.hour = w.h),
m AS (SELECT *, md5(win || ':' || m || ':3') AS e FROM q, range(4) r(m)),
j AS (SELECT win, m, ('0x' || e[13:20])::BIGINT / 4294967296.0 * 2 * pi() AS a, CASE WHEN ('0x' || e[21:21])::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS f, fx, fy FROM m JOIN b ON b.hour = m.hour AND b.k = ('0x' || e[1:12])::BIGINT % m.n)
SELECT win, m, round(fx * cos(a) - fy * f * sin(a), 3) AS x, round(fx * sin(a) + fy * f * cos(a), 3) AS y FROM j""")
def _(spark, d):
    last = tracks.displacements(windows(spark, d), L).where(F.col("pos") == L + H - 1).select("study_id", F.concat(F.col("study_id"), F.col("individual_id"), F.lit(":"), F.col("seg"), F.lit(":"), F.col("start")).alias("win"), F.hour("t_target").alias("hour"), F.floor(F.unix_micros("t_target") / 8.64e10).alias("day"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    pool = last.where("study_id <> 'study_0'").select("hour", "day", F.col("win").alias("key"), "fx", "fy")
    x = scoring.climatology(pool, last.where("study_id = 'study_0'").select("win", "hour"), ["win"], 4)
    return rounded(x.withColumn("m", F.col("m").cast("long")), 3, "x", "y")


MEDIAN = f"""{EMB}, z AS (SELECT 0 AS i, vec_id, avg(x) AS zx, avg(y) AS zy FROM s GROUP BY vec_id
UNION ALL SELECT z.i + 1, s.vec_id, sum(x / greatest(sqrt(pow(x - zx, 2) + pow(y - zy, 2)), 1e-6)) / sum(1 / greatest(sqrt(pow(x - zx, 2) + pow(y - zy, 2)), 1e-6)), sum(y / greatest(sqrt(pow(x - zx, 2) + pow(y - zy, 2)), 1e-6)) / sum(1 / greatest(sqrt(pow(x - zx, 2) + pow(y - zy, 2)), 1e-6)) FROM z JOIN s ON s.vec_id = z.vec_id WHERE z.i < 30 GROUP BY z.i, s.vec_id)"""


@query("region_calibration", f"WITH RECURSIVE {MEDIAN}, r AS (SELECT s.vec_id, sqrt(pow(x - zx, 2) + pow(y - zy, 2)) AS d, sqrt(zx * zx + zy * zy) AS r FROM s JOIN z ON z.vec_id = s.vec_id AND z.i = 30), l AS (SELECT vec_id, level, max(r) AS r, quantile_cont(d, [0.25, 0.5, 0.75, 0.9]) AS q, i FROM r, (VALUES (0.25, 1), (0.5, 2), (0.75, 3), (0.9, 4)) v(level, i) GROUP BY vec_id, level, i) SELECT CAST(level AS DOUBLE) AS level, round(avg(CASE WHEN r <= q[i] THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(q[i]), 5) AS mean_radius FROM l GROUP BY level")
def _(spark, d):
    x = scoring.region_calibration(points(spark, d), "p", F.lit(0.0), F.lit(0.0), [0.25, 0.5, 0.75, 0.9])
    return rounded(rounded(x, 6, "coverage"), 5, "mean_radius")


KDE = f"""{EMB}, cells AS (SELECT row_number() OVER (ORDER BY q, r) - 1 AS cell, q, r, 0.05 * sqrt(3) * (q + r / 2) AS cx, 0.075 * r AS cy FROM range(-4, 5) a(q), range(-4, 5) b(r) WHERE abs(q + r) <= 4),
h AS (SELECT vec_id, greatest(sqrt((var_pop(x) + var_pop(y)) / 2) * pow(32, -1.0 / 6), 0.025) AS h FROM s GROUP BY vec_id),
raw AS (SELECT s.vec_id, cell, least(1.0, avg(exp(-(pow(x - cx, 2) + pow(y - cy, 2)) / (2 * h * h))) / (2 * pi() * max(h) * max(h)) * 1.5 * sqrt(3) * 0.0025) AS p FROM s JOIN h USING (vec_id), cells GROUP BY s.vec_id, cell),
n AS (SELECT vec_id, cell, p / greatest(1.0, sum(p) OVER (PARTITION BY vec_id)) AS p FROM raw),
probs AS (SELECT * FROM n UNION ALL SELECT vec_id, 61, greatest(0.0, 1 - sum(p)) FROM n GROUP BY vec_id)"""


@query("hex_density", f"WITH {KDE} SELECT vec_id, cell, round(p, 6) AS p FROM probs")
def _(spark, d):
    x = points(spark, d).select("vec_id", scoring.hex_density("p", 4, 0.05).alias("probs"))
    return x.select("vec_id", F.posexplode("probs").alias("cell", "p")).select("vec_id", F.col("cell").cast("long").alias("cell"), F.round("p", 6).alias("p"))


@query("hex_scores", f"WITH {KDE}, r9 AS (SELECT vec_id, cell, round(p, 9) AS p FROM probs), t AS (SELECT p.vec_id, e.label % 62 AS truth, cell, p, sum(p) OVER (PARTITION BY p.vec_id) AS total, row_number() OVER (PARTITION BY p.vec_id ORDER BY p DESC, cell) AS rank FROM r9 p JOIN embeddings e USING (vec_id)) SELECT vec_id, round(-ln((1 - 1e-4) * p / total + 1e-4 / 62), 4) AS nll, rank <= 1 AS top1, rank <= 5 AS top5, truth = 61 AS outside FROM t WHERE cell = truth")
def _(spark, d):
    x = points(spark, d).select("vec_id", (F.col("label") % 62).alias("truth"), F.transform(scoring.hex_density("p", 4, 0.05), lambda v: F.round(v, 9)).alias("probs"))
    x = x.select("vec_id", *(c.alias(n) for n, c in scoring.hex_scores("probs", "truth").items()))
    return rounded(x, 4, "nll")


@query("age_days", "SELECT l_orderkey, l_linenumber, o_orderkey, round((epoch_us(o_orderdate) - epoch_us(l_shipdate)) / 8.64e10, 6) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return r6(x.select("l_orderkey", "l_linenumber", "o_orderkey", cov.age_days(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("age")), "age")


@query("wide_join", "WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, min(o_totalprice) AS price FROM orders GROUP BY 1) SELECT k, round(q, 4) AS lines_q, n AS lines_n, round(price, 4) AS orders_price FROM l JOIN o USING (k)")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.count("*").alias("n"))
    orders = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.round(F.min("o_totalprice"), 4).alias("price"))
    return cov.combine({"orders": orders, "lines": lines}, "k")


@query("universe_difference", "WITH a AS (SELECT o_orderkey AS k, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS b FROM lineitem GROUP BY 1) SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a > 1) AS repeated_a, count(*) FILTER (b > 1) AS repeated_b FROM a FULL JOIN b USING (k)")
def _(spark, d):
    return cov.universe_difference(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("missing_profile", "WITH g AS (SELECT unnest([avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END), avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), avg(CASE WHEN l_tax > 0.06 THEN 1.0 ELSE 0 END)]) AS m FROM lineitem) SELECT round(quantile_cont(m, 0.5), 6) AS median_missing, round(max(m), 6) AS max_missing FROM g")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_quantity") <= 25, 1.0).alias("a"), F.when(F.col("l_discount") <= 0.05, 1.0).alias("b"), F.when(F.col("l_tax") <= 0.06, 1.0).alias("c"))
    return r6(cov.missing_profile(x, ["a", "b", "c"]), "median_missing", "max_missing")


@query("standardised", "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem WHERE l_tax > 0.02) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0.02 THEN greatest(-1.5, least(1.5, (l_quantity - m) / d)) ELSE 0 END, 6) AS q, NOT l_tax > 0.02 AS q_missing FROM lineitem, s")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("q"))
    return r6(cov.standardise(x, cov.scaler(x, ["q"]), ["q"], 1.5), "q")


PIX = "px AS (SELECT CAST(floor((90.0 - lat) / 0.01) AS BIGINT) AS r, CAST(floor((lon + 180.0) / 0.01) AS BIGINT) AS c, timestamp AS t, event_id, value AS v, event_type FROM fixes JOIN events USING (event_id))"


def pixel_obs(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    return snapped(spark, d).join(e, "event_id")


def means(spark, d):
    return pixel_obs(spark, d).groupBy(*rasters.PIXEL).agg(F.avg(F.sqrt("value")).alias("v"))


MEANS = f"{FIXES}, {PIX}, m AS (SELECT r, c, avg(sqrt(v)) AS v FROM px GROUP BY r, c)"


@query("composite_median", f"WITH {FIXES}, {PIX}, o AS (SELECT r, c, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) / 16.0) AS BIGINT) AS w, event_id, CASE WHEN event_type <> 'click' THEN v END AS v FROM px) SELECT r AS px_row, c AS px_col, w, round(median(v), 4) AS median, arg_max(v, event_id) FILTER (v IS NOT NULL) AS mosaic, arg_min(v, event_id) FILTER (v IS NOT NULL) AS first, count(v) AS n_valid FROM o GROUP BY ALL")
def _(spark, d):
    from trackloom.operators.pixels import time_key

    x = pixel_obs(spark, d).withColumn("w", time_key(F.col("timestamp"), "composite")).withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return rounded(rasters.composite(x, (*rasters.PIXEL, "w"), "v", "event_id"), 4, "median")


@query("class_fraction", f"WITH {FIXES}, {PIX} SELECT r AS px_row, c AS px_col, round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0 END), 6) AS fraction, count(*) AS n_valid FROM px GROUP BY r, c")
def _(spark, d):
    return r6(rasters.class_fraction(pixel_obs(spark, d), rasters.PIXEL, "event_type", ("click", "view")), "fraction")


@query("focal_reducers", f"WITH {MEANS}, n AS (SELECT a.r, a.c, a.v AS own, b.v FROM m a JOIN m b ON pow(a.r - b.r, 2) + pow(a.c - b.c, 2) <= 4), g AS (SELECT r, c, max(own) AS own, avg(v) AS mean, max(v) - min(v) AS rough, list(v) AS vs FROM n GROUP BY r, c) SELECT r AS px_row, c AS px_col, round(own - mean, 5) AS tpi, round(list_sum(list_transform(vs, lambda u: abs(u - mean))) / len(vs), 5) AS tri, round(rough, 5) AS roughness, round(mean, 5) AS mean FROM g")
def _(spark, d):
    return rounded(rasters.focal(means(spark, d), "v", 2).drop("mode"), 5, "tpi", "tri", "roughness", "mean")


@query("terrain", "WITH m AS (SELECT hour(ts) AS r, day(ts) AS c, avg(sqrt(value)) AS v FROM events GROUP BY 1, 2), n AS (SELECT a.r, a.c, b.v, b.r - a.r AS y, b.c - a.c AS x FROM m a JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1), g AS (SELECT r, c, count(*) AS n, sum(v * x * CASE WHEN x = 0 OR y = 0 THEN 2 ELSE 1 END) / 800 AS gx, sum(v * y * CASE WHEN x = 0 OR y = 0 THEN 2 ELSE 1 END) / 800 AS gy FROM n GROUP BY r, c) SELECT r AS px_row, c AS px_col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g WHERE n = 9")
def _(spark, d):
    x = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("px_row"), F.dayofmonth("ts").cast("long").alias("px_col")).agg(F.avg(F.sqrt("value")).alias("v"))
    return rounded(rasters.terrain(x, "v", 100.0).drop("aspect"), 5, "slope").withColumns({"gx": F.round("gx", 6), "gy": F.round("gy", 6)})


@query("band_rate", f"WITH {FIXES}, {PIX}, o AS (SELECT r, c, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) / 4.0) AS BIGINT) AS w, round(median(v), 4) AS median FROM px GROUP BY ALL) SELECT o.r AS px_row, o.c AS px_col, o.w, o.median, round((o.median - p.median) / 8.0, 6) AS rate FROM o LEFT JOIN o p ON p.r = o.r AND p.c = o.c AND p.w = o.w - 2")
def _(spark, d):
    from trackloom.operators.pixels import time_key

    x = pixel_obs(spark, d).withColumn("w", time_key(F.col("timestamp"), "composite", 2))
    x = rounded(rasters.composite(x, (*rasters.PIXEL, "w"), "value", "event_id"), 4, "median").select(*rasters.PIXEL, "w", "median")
    return r6(rasters.band_rate(x, rasters.PIXEL, "w", "median", 2, 2), "rate")


@query("distance_to_water", f"WITH {MEANS}, s AS (SELECT r, c FROM m WHERE v >= 8) SELECT m.r AS px_row, m.c AS px_col, round(min(CASE WHEN sqrt(pow(m.r - s.r, 2) + pow(m.c - s.c, 2)) <= 3 THEN sqrt(pow(m.r - s.r, 2) + pow(m.c - s.c, 2)) END), 5) AS distance FROM m LEFT JOIN s ON true GROUP BY m.r, m.c")
def _(spark, d):
    return rounded(rasters.distance_to(means(spark, d), "v", 8.0, 3), 5, "distance")


@query("footprint_filter", f"WITH {FIXES}, b AS (SELECT min(lon) - 0.001 AS west, max(lon) + 0.001 AS east, min(lat) - 0.001 AS south, max(lat) + 0.001 AS north FROM fixes WHERE individual_id = 'u1') SELECT event_id FROM fixes, b WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north")
def _(spark, d):
    x = fixes(spark, d)
    return rasters.within(x, rasters.footprint(x.where("individual_id = 'u1'"), 0.001)).select("event_id")


@query("derived_bands", "SELECT l_orderkey, l_linenumber, round(1.5 * (l_quantity - l_tax) / nullif(l_quantity + l_tax + 0.5, 0), 6) AS savi, round(sqrt(pow(l_discount, 2) + pow(l_tax, 2)), 6) AS wind FROM lineitem")
def _(spark, d):
    band = lambda n: F.col({"B8": "l_quantity", "B4": "l_tax", "u": "l_discount", "v": "l_tax"}[n])
    x = table(spark, d, "lineitem")
    return r6(x.select("l_orderkey", "l_linenumber", bands.band_expression("1.5 * (b('B8') - b('B4')) / (b('B8') + b('B4') + 0.5)", band).alias("savi"), bands.band_expression("sqrt(b('u') ** 2 + b('v') ** 2)", band).alias("wind")), "savi", "wind")


@query("utm_pixels")
def _(spark, d):
    x, y = projection.utm(F.col("lon"), F.col("lat"))
    return fixes(spark, d).select("event_id", projection.utm_zone(F.col("lon")).cast("long").alias("zone"), F.floor(x / 30).alias("px_col"), F.floor((10000000.0 - y) / 30).alias("px_row"))


@query("study_pivot", "SELECT year(l_shipdate) AS unit, round(avg(l_tax) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_tax) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_tax) FILTER (l_returnflag = 'R'), 6) AS R, round(least(avg(l_tax) FILTER (l_returnflag = 'A'), avg(l_tax) FILTER (l_returnflag = 'N'), avg(l_tax) FILTER (l_returnflag = 'R')), 6) AS best FROM lineitem GROUP BY 1")
def _(spark, d):
    x = studies.pivot(table(spark, d, "lineitem").withColumn("unit", F.year("l_shipdate").cast("long")), "unit", "l_returnflag", "l_tax", ["A", "N", "R"])
    return r6(x, "A", "N", "R", "best")


@query("study_flags", "SELECT l_orderkey, l_linenumber, coalesce(l_discount / nullif(l_tax, 0) >= 0.97, false) AND NOT l_returnflag = 'A' AS collapsed, l_quantity >= 0.9 * 50 - 1 AND l_linestatus <> 'F' AS improving FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("ade"), F.col("l_tax").alias("ade_cp"), (F.col("l_returnflag") == "A").alias("probabilistic"), F.col("l_quantity").alias("best_epoch"), F.lit(50).alias("max_epochs"), (F.col("l_linestatus") == "F").alias("stopped_early"))
    return studies.flags(x).select("l_orderkey", "l_linenumber", "collapsed", "improving")


SEASONS = "o AS (SELECT *, CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 401 AND 630 THEN 'spring' WHEN month(o_orderdate) * 100 + day(o_orderdate) >= 1201 OR month(o_orderdate) * 100 + day(o_orderdate) <= 315 THEN 'winter' ELSE 'summer_autumn' END AS season FROM orders)"


def seasons(spark, d):
    return table(spark, d, "orders").withColumn("season", geo.season(F.col("o_orderdate")))


@query("fold_sign", f"WITH {SEASONS}, f AS (SELECT season, o_custkey % 5 AS fold, avg(o_totalprice - 250000) AS m, sum(o_totalprice - 250000) AS s, count(*) AS n FROM o GROUP BY 1, 2) SELECT season, round(sum(s) / sum(n), 4) AS mean, count(*) AS folds, CAST(sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_folds FROM f GROUP BY season")
def _(spark, d):
    x = seasons(spark, d).select("season", (F.col("o_custkey") % 5).alias("fold"), (F.col("o_totalprice") - 250000).alias("delta"))
    return rounded(studies.sign_counts(x, "fold", "season", "delta"), 4, "mean")


@query("season_contrast", f"""WITH {SEASONS}, c AS (SELECT o_custkey, coalesce(sum(o_totalprice) FILTER (season = 'spring'), 0) AS sa, count(*) FILTER (season = 'spring') AS na, coalesce(sum(o_totalprice) FILTER (season = 'winter'), 0) AS sb, count(*) FILTER (season = 'winter') AS nb FROM o GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS k, count(*) OVER () AS n FROM c),
p AS (SELECT i, ('0x' || md5(i || ':' || k || ':5')[1:12])::BIGINT % n AS k FROM k, range(4000) r(i)),
r AS (SELECT i, sum(sa) / greatest(sum(na), 1) - sum(sb) / greatest(sum(nb), 1) AS r FROM p JOIN k USING (k) GROUP BY i)
SELECT round(avg(r), 3) AS mean, round(quantile_cont(r, 0.025), 3) AS lo, round(quantile_cont(r, 0.975), 3) AS hi, count(*) AS draws FROM r""")
def _(spark, d):
    return rounded(studies.contrast(seasons(spark, d), "o_custkey", "season", "o_totalprice", "spring", "winter", 4000), 3, "mean", "lo", "hi")


@query("best_trial", "SELECT l_returnflag, l_linestatus, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS trial, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return studies.best_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", "l_extendedprice", "l_orderkey")


@query("trial_families", "SELECT l_returnflag, l_linestatus, round(avg(l_tax), 6) AS mean, round(coalesce(stddev_samp(l_tax), 0), 6) AS sd, count(l_tax) AS n, coalesce(stddev_samp(l_tax), 0) > 0.1 * avg(l_tax) AS unclear FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return r6(studies.families(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax"), "mean", "sd")


@query("top_weights", "SELECT l_suppkey, round(avg(l_tax), 6) AS mean, round(avg(l_tax) FILTER (l_quantity > 10), 6) AS mean_observed, round(avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0 END), 6) AS observed FROM (SELECT *, avg(l_tax) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) GROUP BY l_suppkey ORDER BY avg(l_tax) DESC, l_suppkey LIMIT 15")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("observed", F.col("l_quantity") > 10)
    return r6(studies.top_weights(x, "l_suppkey", "l_tax"), "mean", "mean_observed", "observed")


@query("pooled_curve", "WITH r AS (SELECT l_quantity AS w, unnest([{'level': 0.5, 'v': l_discount}, {'level': 0.9, 'v': l_tax}]) AS u FROM lineitem) SELECT CAST(u.level AS DOUBLE) AS level, round(sum(u.v * w) / sum(w), 6) AS coverage FROM r GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", F.to_json(F.create_map(F.lit("0.5"), "l_discount", F.lit("0.9"), "l_tax")).alias("curve"))
    return r6(studies.pooled_curve(x, "curve", "l_quantity"), "coverage")


@query("trial_grid", "WITH g AS (SELECT r_name, n_name, seed FROM region, nation, range(3) s(seed)) SELECT *, sha256(n_name || '|' || r_name || '|' || seed)[1:16] AS trial_id FROM g")
def _(spark, d):
    return studies.grid(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), spark.range(3).withColumnRenamed("id", "seed"))


@query("default_rank", "WITH k AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank, abs(l_tax - 0.04) + abs(l_discount - 0.05) AS dist, l_orderkey * 10 + l_linenumber AS o FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem) WHERE m = 1) SELECT l_returnflag, CAST(arg_min(rank, (round(dist, 6), o)) AS BIGINT) AS rank FROM k GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count = 1"), ["l_orderkey", "l_linenumber"]).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    x = studies.nearest_trial(x, ["l_returnflag"], "l_extendedprice", F.round(F.abs(F.col("l_tax") - 0.04) + F.abs(F.col("l_discount") - 0.05), 6), "o")
    return x.withColumn("rank", F.col("rank").cast("long"))


@query("early_stopping")
def _(spark, d):
    x = table(spark, d, "events").select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return studies.early_stopping(x, "user_id", "epoch", "loss", 5)


@query("key_digest")
def _(spark, d):
    return cov.key_digest(snapped(spark, d).select("px_row", "px_col", "t0").distinct(), ["px_row", "px_col", "t0"])


ORACLE_SQL["spatial_median"] = f"WITH RECURSIVE {MEDIAN} SELECT vec_id, round(zx, 6) AS mx, round(zy, 6) AS my FROM z WHERE i = 30"

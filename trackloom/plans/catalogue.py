"""The queries: each applies operators to the test tables; the SQL says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import covariates as cov
from trackloom.operators import pixels, scoring, studies, tracks
from trackloom.plans.registry import query, table
from trackloom.sources.tracks import fixes_of_events

GAP_S, L, H = 22 * 3600, 6, 3
R = geo.R


def fixes(spark, d):
    return fixes_of_events(table(spark, d, "events"))


def r6(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


FIXES = """
fixes AS (SELECT event_id, 'study_' || (user_id % 3) AS study_id, 'u' || user_id AS individual_id, ts AS timestamp,
  38.0 + value / 10000.0 AS lat, -100.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1000.0 AS lon FROM events)"""
STEPS = f"""{FIXES},
lagged AS (SELECT *, lag(timestamp) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes
  WINDOW w AS (PARTITION BY study_id, individual_id ORDER BY timestamp)),
steps AS (SELECT *, (epoch_us(timestamp) - epoch_us(pt)) / 1e6 AS dt_s,
  sqrt(pow({R} * radians(lon - plon) * cos(radians((plat + lat) / 2)), 2) + pow({R} * radians(lat - plat), 2)) AS step_m FROM lagged)"""
SEGS = f"""{STEPS},
segs AS (SELECT *, CAST(sum(CASE WHEN dt_s > {GAP_S} THEN 1 ELSE 0 END) OVER (PARTITION BY study_id, individual_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM steps)"""
WINS = f"""{SEGS},
placed AS (SELECT *, row_number() OVER (PARTITION BY study_id, individual_id, seg ORDER BY timestamp) - 1 AS i,
  count(*) OVER (PARTITION BY study_id, individual_id, seg) AS n FROM segs),
wins AS (SELECT a.study_id, a.individual_id, a.seg, a.i AS start, b.i - a.i AS pos, b.lat, b.lon, b.timestamp FROM placed a
  JOIN placed b ON a.study_id = b.study_id AND a.individual_id = b.individual_id AND a.seg = b.seg AND b.i BETWEEN a.i AND a.i + {L + H - 1} WHERE a.i + {L + H} <= a.n)"""
DISP = f"""{WINS},
origin AS (SELECT study_id, individual_id, seg, start, lat AS lat0, lon AS lon0 FROM wins WHERE pos = {L - 1}),
xy AS (SELECT w.*, {R} * radians(lon - lon0) * cos(radians(lat0)) AS x, {R} * radians(lat - lat0) AS y FROM wins w JOIN origin USING (study_id, individual_id, seg, start)),
disp AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy FROM xy WINDOW w AS (PARTITION BY study_id, individual_id, seg, start ORDER BY pos)),
errs AS (SELECT *, pos - {L} + 1 AS step, sqrt(x * x + y * y) AS cp_m, sqrt(pow(x - (pos - {L} + 1) * vx, 2) + pow(y - (pos - {L} + 1) * vy, 2)) AS cv_m FROM
  (SELECT *, max(CASE WHEN pos = {L - 1} THEN dx END) OVER v AS vx, max(CASE WHEN pos = {L - 1} THEN dy END) OVER v AS vy FROM disp WINDOW v AS (PARTITION BY study_id, individual_id, seg, start)) WHERE pos >= {L})"""


@query("fix_scan_clean", f"WITH {FIXES} SELECT event_id, study_id || '::' || individual_id AS animal, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fixes WHERE lat IS NOT NULL AND lon IS NOT NULL")
def _(spark, d):
    return r6(fixes(spark, d).dropna(subset=["lat", "lon"]).select("event_id", F.concat_ws("::", "study_id", "individual_id").alias("animal"), "lat", "lon"), "lat", "lon")


@query("fix_id_hash", f"WITH {FIXES} SELECT event_id, sha1(study_id || '|' || individual_id || '|' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ')) AS fix_id FROM fixes")
def _(spark, d):
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return fixes(spark, d).select("event_id", F.sha1(F.concat_ws("|", "study_id", "individual_id", iso)).alias("fix_id"))


ORDER_FIXES = "SELECT o_orderkey AS event_id, 's' AS study_id, CAST(o_custkey AS VARCHAR) AS individual_id, o_orderdate AS timestamp, o_totalprice AS lat, 0.0 AS lon FROM orders"


def order_fixes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("s").alias("study_id"), F.col("o_custkey").cast("string").alias("individual_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("lat"), F.lit(0.0).alias("lon"))


@query("dedup_keep_first", f"SELECT min(event_id) AS event_id, individual_id, count(*) AS n FROM ({ORDER_FIXES}) GROUP BY individual_id, timestamp HAVING count(*) > 0")
def _(spark, d):
    x = order_fixes(spark, d)
    n = x.groupBy("individual_id", "timestamp").agg(F.count("*").alias("n"))
    return tracks.dedup_fixes(x).join(n, ["individual_id", "timestamp"]).select("event_id", "individual_id", "n")


@query("interval_profile", f"WITH {STEPS}, h AS (SELECT dt_s / 3600 AS h FROM steps WHERE dt_s > 0), m AS (SELECT quantile_cont(h, 0.5) AS median_h FROM h) SELECT round(median_h, 6) AS median_h, round(avg(CASE WHEN h BETWEEN 0.9 * median_h AND 1.1 * median_h THEN 1.0 ELSE 0 END), 6) AS regular_share, count(*) AS n FROM h, m GROUP BY median_h")
def _(spark, d):
    return r6(tracks.sampling_profile(fixes(spark, d)), "median_h", "regular_share")


@query("interval_mode_hist", f"WITH {STEPS}, h AS (SELECT dt_s / 3600 AS h FROM steps WHERE dt_s > 0 AND dt_s <= 72 * 3600), e AS (SELECT min(h) AS lo, max(h) AS hi FROM h), b AS (SELECT lo, hi, CAST(least(floor((h - lo) / ((hi - lo) / 200)), 199) AS BIGINT) AS bin FROM h, e) SELECT bin, count(*) AS n, round(lo + (bin + 0.5) * (hi - lo) / 200, 6) AS modal_h FROM b GROUP BY bin, lo, hi ORDER BY n DESC, bin LIMIT 1")
def _(spark, d):
    return r6(tracks.modal_interval(fixes(spark, d)), "modal_h")


@query("window_scaling", "SELECT dt_h, CAST(least(128, greatest(2, round_even(24 / greatest(dt_h, 0.25), 0))) AS BIGINT) AS input_len, CAST(least(64, greatest(1, round_even(12 / greatest(dt_h, 0.25), 0))) AS BIGINT) AS horizon, round(greatest(3.0, 1 / greatest(dt_h, 0.25)) * greatest(dt_h, 0.25) / dt_h, 6) AS gap_multiplier FROM (SELECT DISTINCT l_quantity / 4 AS dt_h FROM lineitem)")
def _(spark, d):
    return r6(tracks.window_scaling(table(spark, d, "lineitem").select((F.col("l_quantity") / 4).alias("dt_h")).distinct()), "gap_multiplier")


@query("step_speed", f"WITH {STEPS} SELECT event_id, round(dt_s, 3) AS dt_s, round(step_m, 3) AS step_m, round(step_m / nullif(dt_s, 0), 3) AS speed_mps FROM steps")
def _(spark, d):
    x = tracks.with_steps(fixes(spark, d)).select("event_id", "dt_s", "step_m", "speed_mps")
    return x.withColumns({"dt_s": F.round("dt_s", 3), "step_m": F.round("step_m", 3), "speed_mps": F.round("speed_mps", 3)})


@query("step_haversine", f"WITH {STEPS} SELECT event_id, round(2 * {R} * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))), 3) AS metres FROM steps WHERE plat IS NOT NULL")
def _(spark, d):
    w = Window.partitionBy("study_id", "individual_id").orderBy("timestamp")
    x = fixes(spark, d).withColumn("plat", F.lag("lat").over(w)).withColumn("plon", F.lag("lon").over(w)).where("plat is not null")
    return x.select("event_id", F.round(geo.haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("trajectory_segments", f"WITH {SEGS.replace('FROM fixes', 'FROM once', 1).replace('lagged AS', 'once AS (SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY study_id, individual_id, timestamp ORDER BY event_id) = 1), lagged AS', 1)} SELECT event_id, study_id, individual_id, seg FROM segs")
def _(spark, d):
    return tracks.segments(tracks.once(fixes(spark, d)), GAP_S).select("event_id", "study_id", "individual_id", "seg")


@query("segments_speed_cap", f"WITH {STEPS} SELECT event_id, CAST(sum(CASE WHEN dt_s > {GAP_S} OR coalesce(step_m / nullif(dt_s, 0), 0) > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY study_id, individual_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM steps")
def _(spark, d):
    return tracks.segments(fixes(spark, d), GAP_S, 2.0).select("event_id", "seg")


@query("discard_short", f"WITH {SEGS}, c AS (SELECT *, count(*) OVER (PARTITION BY study_id, individual_id, seg) AS n_fixes FROM segs) SELECT event_id, seg, n_fixes FROM c WHERE n_fixes >= {L + H}")
def _(spark, d):
    return tracks.discard_short(tracks.segments(fixes(spark, d), GAP_S), L + H).select("event_id", "seg", "n_fixes")


@query("session_window_segments", f"WITH {SEGS} SELECT individual_id, min(CAST(timestamp AS VARCHAR)) AS first, count(*) AS n FROM segs GROUP BY study_id, individual_id, seg")
def _(spark, d):
    # An event exactly at the gap still joins its session in both forms.
    x = fixes(spark, d).groupBy("individual_id", F.session_window("timestamp", f"{GAP_S} seconds")).agg(F.min("timestamp").alias("t"), F.count("*").alias("n"))
    stamp = F.when(F.date_format("t", "SSSSSS") == "000000", F.date_format("t", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("t").cast("string"))
    return x.select("individual_id", stamp.alias("first"), "n")


def windows(spark, d):
    return tracks.sliding_windows(tracks.segments(fixes(spark, d), GAP_S), L, H)


@query("sliding_windows", f"WITH {WINS} SELECT individual_id, seg, start, round(sum(lat), 6) AS lat_sum, max(CASE WHEN pos = {L} THEN epoch_us(timestamp) END) AS t_target FROM wins GROUP BY study_id, individual_id, seg, start")
def _(spark, d):
    return windows(spark, d).select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.round(F.expr("aggregate(window, 0d, (s, p) -> s + p.lat)"), 6).alias("lat_sum"), F.unix_micros("t_target").alias("t_target"))


@query("window_deltas", f"WITH {DISP} SELECT individual_id, seg, start, pos, round(dx, 3) AS dx, round(dy, 3) AS dy FROM disp")
def _(spark, d):
    x = tracks.displacements(windows(spark, d), L)
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"))


@query("feature_scaler", f"WITH {DISP} SELECT round(avg(dx), 4) AS dx_mean, round(stddev_pop(dx), 4) AS dx_std, round(avg(dy), 4) AS dy_mean, round(stddev_pop(dy), 4) AS dy_std FROM disp WHERE pos < {L}")
def _(spark, d):
    x = cov.scaler(tracks.displacements(windows(spark, d), L).where(F.col("pos") < L), ["dx", "dy"])
    return x.select(*(F.round(c, 4).alias(c) for c in x.columns))


def errors(spark, d):
    return scoring.baseline_errors(tracks.displacements(windows(spark, d), L), L)


@query("per_horizon", f"WITH {DISP} SELECT step, round(avg(cp_m), 4) AS ade_cp, round(avg(cv_m), 4) AS ade_cv, round(sqrt(avg((x * x + y * y) / 2)), 4) AS rmse_cp, count(*) AS n FROM errs GROUP BY step")
def _(spark, d):
    x = scoring.per_horizon(errors(spark, d))
    return x.select(F.col("step").cast("long").alias("step"), *(F.round(c, 4).alias(c) for c in ("ade_cp", "ade_cv", "rmse_cp")), "n")


@query("per_window", f"WITH {DISP} SELECT individual_id, seg, start, round(avg(cp_m), 3) AS ade_cp, round(max(CASE WHEN step = {H} THEN cp_m END), 3) AS fde_cp, round(avg(cv_m), 3) AS ade_cv, round(max(CASE WHEN step = {H} THEN cv_m END), 3) AS fde_cv FROM errs GROUP BY study_id, individual_id, seg, start")
def _(spark, d):
    x = scoring.per_window(errors(spark, d))
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), *(F.round(c, 3).alias(c) for c in ("ade_cp", "fde_cp", "ade_cv", "fde_cv")))


@query("target_rms", f"WITH {DISP} SELECT round(sqrt(avg((dx * dx + dy * dy) / 2)), 4) AS rms FROM disp WHERE pos >= {L}")
def _(spark, d):
    return tracks.displacements(windows(spark, d), L).where(F.col("pos") >= L).agg(F.round(F.sqrt(F.avg((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 2)), 4).alias("rms"))


@query("tail_cut", f"WITH {FIXES}, k AS (SELECT *, row_number() OVER (PARTITION BY study_id, individual_id ORDER BY timestamp) - 1 AS k, count(*) OVER (PARTITION BY study_id, individual_id) AS n FROM fixes) SELECT individual_id, epoch_us(timestamp) AS val_cut, n FROM k WHERE k = least(n - 1, CAST(floor((1 - 0.15) * n) AS BIGINT))")
def _(spark, d):
    return tracks.tail_cuts(fixes(spark, d), 0.15).select("individual_id", F.unix_micros("val_cut").alias("val_cut"), "n")


SPLIT = f"""WITH {FIXES}, a AS (SELECT DISTINCT study_id, individual_id FROM fixes),
k AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY sha256(individual_id || ':7'), individual_id) AS k, count(*) OVER (PARTITION BY study_id) AS n FROM a),
v AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - 2)) AS n_val FROM k),
t AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - n_val - 1)) AS n_test FROM v),
s AS (SELECT study_id, individual_id, CASE WHEN n < 3 THEN 'train' WHEN k <= n_val THEN 'val' WHEN k <= n_val + n_test THEN 'test' ELSE 'train' END AS split FROM t)"""


@query("split_individual", f"{SPLIT} SELECT * FROM s")
def _(spark, d):
    return tracks.split_animals(fixes(spark, d), 0.2, 0.2)


@query("split_disjoint_check", f"{SPLIT} SELECT count(*) AS animals, count(DISTINCT study_id || individual_id) AS distinct_animals, CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS val FROM s")
def _(spark, d):
    return tracks.split_animals(fixes(spark, d), 0.2, 0.2).agg(F.count("*").alias("animals"), F.countDistinct(F.concat("study_id", "individual_id")).alias("distinct_animals"), F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("val"))


SNAP = f"""{FIXES}, snap AS (SELECT *, CAST(floor((lon + 180.0) / 0.01) AS BIGINT) AS px_col, CAST(floor((90.0 - lat) / 0.01) AS BIGINT) AS px_row,
  year(timestamp) * 10000 + month(timestamp) * 100 + day(timestamp) AS t0 FROM fixes)"""


def snapped(spark, d):
    x = pixels.snap(fixes(spark, d), 0.01)
    return x.withColumn("t0", pixels.time_key(F.col("timestamp"), "daily"))


@query("grid_snap", f"WITH {SNAP} SELECT event_id, px_row, px_col, round(-180.0 + (px_col + 0.5) * 0.01, 6) AS px_lon, round(90.0 - (px_row + 0.5) * 0.01, 6) AS px_lat FROM snap")
def _(spark, d):
    return r6(snapped(spark, d).select("event_id", "px_row", "px_col", "px_lon", "px_lat"), "px_lon", "px_lat")


@query("time_keys", f"WITH {FIXES} SELECT event_id, 0::BIGINT AS static, year(timestamp) AS annual, year(timestamp) * 100 + month(timestamp) AS monthly, year(timestamp) * 10000 + month(timestamp) * 100 + day(timestamp) AS daily, (year(timestamp) * 10000 + month(timestamp) * 100 + day(timestamp)) * 100 + hour(timestamp) AS hourly, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(timestamp AS DATE)) / 16.0) AS BIGINT) AS composite FROM fixes")
def _(spark, d):
    return fixes(spark, d).select("event_id", *(pixels.time_key(F.col("timestamp"), c).alias(c) for c in ("static", "annual", "monthly", "daily", "hourly", "composite")))


@query("nominal_age", f"WITH {FIXES} SELECT event_id, round(abs(epoch_us(timestamp) - epoch_us(date_trunc('hour', timestamp))) / 3.6e9, 6) AS hourly, round(abs(epoch_us(timestamp) - epoch_us(date_trunc('day', timestamp) + INTERVAL 12 HOUR)) / 3.6e9, 6) AS daily, round(abs(epoch_us(timestamp) - epoch_us(date_trunc('month', timestamp) + INTERVAL 14 DAY + INTERVAL 12 HOUR)) / 3.6e9, 6) AS monthly, round(abs(epoch_us(timestamp) - epoch_us(date_trunc('year', timestamp) + INTERVAL 6 MONTH + INTERVAL 12 HOUR)) / 3.6e9, 6) AS annual FROM fixes")
def _(spark, d):
    t = F.col("timestamp")
    age = lambda c: F.round(F.abs(F.unix_micros(t) - F.unix_micros(pixels.nominal_time(t, c).cast("timestamp"))) / 3.6e9, 6).alias(c)
    return fixes(spark, d).select("event_id", *(age(c) for c in ("hourly", "daily", "monthly", "annual")))


@query("key_dedup", f"WITH {SNAP} SELECT px_row, px_col, t0, count(*) AS n_fixes, min(epoch_us(timestamp)) AS t_ref, dense_rank() OVER (ORDER BY px_row, px_col, t0) - 1 AS key_index FROM snap GROUP BY px_row, px_col, t0")
def _(spark, d):
    return pixels.number_keys(pixels.keys_of(snapped(spark, d))).select("px_row", "px_col", "t0", "n_fixes", F.unix_micros("t_ref").alias("t_ref"), "key_index")


@query("fixmap", f"WITH {SNAP} SELECT event_id, dense_rank() OVER (ORDER BY px_row, px_col, t0) - 1 AS key_index FROM snap")
def _(spark, d):
    x = snapped(spark, d)
    return x.join(pixels.number_keys(pixels.keys_of(x)), list(pixels.KEY)).select("event_id", "key_index")


@query("reduction_summary", f"WITH {SNAP} SELECT count(*) AS fixes, count(DISTINCT (px_row, px_col, t0)) AS keys, count(DISTINCT (px_row, px_col)) AS pixels, round(count(DISTINCT (px_row, px_col, t0)) / count(*), 6) AS key_ratio, round(count(DISTINCT (px_row, px_col)) / count(*), 6) AS pixel_ratio FROM snap")
def _(spark, d):
    return r6(pixels.reduction(snapped(spark, d)), "key_ratio", "pixel_ratio")


@query("covariate_left_join", f"WITH {FIXES}, c AS (SELECT 'u' || user_id AS individual_id, min_by(value, event_id) AS cov FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT event_id, round(cov, 6) AS cov, cov IS NOT NULL AS matched FROM fixes LEFT JOIN c USING (individual_id)")
def _(spark, d):
    c = table(spark, d, "events").where("event_type = 'click'").select(F.concat(F.lit("u"), F.col("user_id")).alias("individual_id"), F.col("value").alias("cov"), F.col("event_id").alias("ordinal"))
    return r6(cov.attach(fixes(spark, d), c, ["individual_id"], "ordinal").select("event_id", "cov", "matched"), "cov")


@query("covariate_scaler", "SELECT round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_pop(l_tax), 6) AS l_tax_std FROM lineitem")
def _(spark, d):
    x = cov.scaler(table(spark, d, "lineitem"), ["l_discount", "l_tax"])
    return r6(x, *x.columns)


@query("bounded_clip", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_discount * 20 - 1, -0.5), 0.5), 6) AS clipped FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(cov.clip(F.col("l_discount") * 20 - 1, -0.5, 0.5), 6).alias("clipped"))


@query("spectral_indices", "SELECT l_orderkey, l_linenumber, round((l_quantity - l_tax * 100) / nullif(l_quantity + l_tax * 100, 0), 6) AS ndvi, round(2.5 * (l_quantity - l_tax) / nullif(l_quantity + 6 * l_tax - 7.5 * l_discount + 1, 0), 6) AS evi FROM lineitem")
def _(spark, d):
    q, t, s = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return r6(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cov.ratio_index(q, t * 100).alias("ndvi"), cov.evi(q, t, s).alias("evi")), "ndvi", "evi")


@query("qa_mask_bits", "SELECT l_orderkey, l_linenumber, (l_partkey >> 2) & 7 AS b24, CASE WHEN l_partkey & 3 <= 1 THEN l_quantity END AS masked FROM lineitem")
def _(spark, d):
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.bits(k, 2, 4).alias("b24"), F.when(geo.bits(k, 0, 1) <= 1, F.col("l_quantity")).alias("masked"))


EMB = "x AS (SELECT vec_id, label, unnest(range(32)) AS m, embedding FROM embeddings), s AS (SELECT vec_id, label, m, CAST(embedding[2 * m + 1] AS DOUBLE) AS x, CAST(embedding[2 * m + 2] AS DOUBLE) AS y FROM x)"


@query("energy_score", f"WITH {EMB}, f AS (SELECT vec_id, avg(sqrt(x * x + y * y + 1e-9)) AS a FROM s GROUP BY vec_id), p AS (SELECT s.vec_id, sum(sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2) + 1e-9)) AS b FROM s JOIN s t ON s.vec_id = t.vec_id GROUP BY s.vec_id) SELECT vec_id, round(a - b / (2 * 32 * 31), 6) AS es FROM f JOIN p USING (vec_id)")
def _(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.expr(scoring.pairs_of("embedding")).alias("p"))
    return x.select("vec_id", F.round(scoring.energy_score("p", "0d", "0d"), 6).alias("es"))


@query("spatial_median")
def _(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.expr(scoring.pairs_of("embedding")).alias("p"))
    return x.select("vec_id", scoring.spatial_median("p").alias("z")).select("vec_id", F.round("z.x", 6).alias("mx"), F.round("z.y", 6).alias("my"))


@query("hex_assign", f"WITH {EMB}, a AS (SELECT vec_id, m, sqrt(3) / 3 * x / 0.05 - y / 0.15 AS qf, 2 * y / 0.15 AS rf FROM s), b AS (SELECT *, round_even(qf, 0) AS q0, round_even(rf, 0) AS r0, round_even(-qf - rf, 0) AS s0 FROM a), c AS (SELECT *, abs(q0 - qf) AS dq, abs(r0 - rf) AS dr, abs(s0 + qf + rf) AS ds FROM b), e AS (SELECT vec_id, m, CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS q, CASE WHEN dq > dr AND dq > ds THEN r0 WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS r FROM c) SELECT vec_id, m, CAST(q AS BIGINT) AS q, CAST(r AS BIGINT) AS r, greatest(abs(q), abs(r), abs(q + r)) > 4 AS outside FROM e")
def _(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.expr(scoring.pairs_of("embedding"))).alias("m", "p"))
    c = geo.hex_cell(F.col("p.x"), F.col("p.y"), 0.05, 4)
    return x.select("vec_id", F.col("m").cast("long").alias("m"), *(v.alias(k) for k, v in c.items()))


@query("memory_home_range", f"WITH {FIXES}, t AS (SELECT *, CAST(floor(epoch_us(timestamp) / 1e6) AS BIGINT) AS t FROM fixes), w AS (SELECT event_id, lat, lon, t, count(*) OVER v AS n, avg(lat) OVER v AS mlat, avg(lon) OVER v AS mlon, min(t) OVER v AS t0 FROM t WINDOW v AS (PARTITION BY study_id, individual_id ORDER BY t RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW)), c AS (SELECT *, {R} * radians(mlon - lon) * cos(radians(lat)) AS cx, {R} * radians(mlat - lat) AS cy FROM w) SELECT event_id, n, round(cx, 3) AS centre_dx, round(cy, 3) AS centre_dy, sqrt(cx * cx + cy * cy) <= 20000 AS near, round(least(1.0, (t - t0) / 432000.0), 6) AS history FROM c")
def _(spark, d):
    x = tracks.home_range(fixes(spark, d), 5, 20_000)
    return x.withColumns({"centre_dx": F.round("centre_dx", 3), "centre_dy": F.round("centre_dy", 3), "history": F.round("history", 6)})


@query("solar_time", f"WITH {FIXES}, t AS (SELECT event_id, epoch_us(timestamp) / 1e6 AS t, lon FROM fixes), h AS (SELECT event_id, (((t % 86400.0) / 3600 + lon / 15) % 24.0 + 24.0) % 24.0 AS h, ((t / 86400) % 365.2422) / 365.2422 AS p FROM t) SELECT event_id, round(sin(2 * pi() * h / 24), 5) AS hour_sin, round(cos(2 * pi() * h / 24), 5) AS hour_cos, round(sin(2 * pi() * p), 5) AS year_sin, round(cos(2 * pi() * p), 5) AS year_cos FROM h")
def _(spark, d):
    s = geo.solar_time(geo.epoch_s(F.col("timestamp")), F.col("lon"))
    return fixes(spark, d).select("event_id", *(F.round(v, 5).alias(k) for k, v in s.items()))


@query("embargo", f"WITH {FIXES}, l AS (SELECT *, max(timestamp) OVER (PARTITION BY study_id, individual_id) AS t_last FROM fixes) SELECT event_id, CASE WHEN epoch_us(t_last) - epoch_us(timestamp) < 172800000000 THEN NULL ELSE round(lat, 6) END AS cov, epoch_us(t_last) - epoch_us(timestamp) < 172800000000 AS missing FROM l")
def _(spark, d):
    late = F.unix_micros(F.max("timestamp").over(Window.partitionBy("study_id", "individual_id"))) - F.unix_micros("timestamp") < 172800000000
    return fixes(spark, d).withColumn("missing", late).select("event_id", F.when(~F.col("missing"), F.round("lat", 6)).alias("cov"), "missing")


SEASON = "CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 401 AND 630 THEN 'spring' WHEN month(o_orderdate) * 100 + day(o_orderdate) >= 1201 OR month(o_orderdate) * 100 + day(o_orderdate) <= 315 THEN 'winter' ELSE 'summer_autumn' END"


@query("season_rollup", f"WITH s AS (SELECT {SEASON} AS season, o_totalprice FROM orders) SELECT coalesce(season, 'all') AS season, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM s GROUP BY ROLLUP (season)")
def _(spark, d):
    x = table(spark, d, "orders").select(geo.season(F.col("o_orderdate")).alias("season"), "o_totalprice")
    return studies.with_totals(x, "season", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("animal_bootstrap")
def _(spark, d):
    x = studies.bootstrap(table(spark, d, "orders"), "o_custkey", "o_totalprice", 4000)
    return x.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "draws")


@query("study_pooled", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS pooled, count(l_discount) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return r6(studies.pooled(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_quantity"), "pooled")


@query("study_paired", "WITH p AS (SELECT year(l_shipdate) AS unit, avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1) SELECT unit, round(a, 4) AS a, round(b, 4) AS b, round(a - b, 4) AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    x = studies.paired(table(spark, d, "lineitem").withColumn("unit", F.year("l_shipdate").cast("long")), "unit", "l_returnflag", "l_extendedprice", "A", "R")
    return x.select("unit", *(F.round(c, 4).alias(c) for c in ("a", "b", "diff")))


@query("family_stats", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return r6(studies.arm_summary(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), "mean", "sd")


@query("arm_ranking", "WITH b AS (SELECT year(l_shipdate) AS unit, l_returnflag, min(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT unit, string_agg(l_returnflag, ' > ' ORDER BY v, l_returnflag) AS ranking FROM b GROUP BY unit")
def _(spark, d):
    return studies.ranking(table(spark, d, "lineitem").withColumn("unit", F.year("l_shipdate").cast("long")), "unit", "l_returnflag", "l_extendedprice")


@query("ledger_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return pixels.last_wins(table(spark, d, "events"), "user_id", "event_id").select("user_id", F.col("event_type").alias("status"), "event_id")


@query("resume_anti", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id) SELECT user_id FROM l WHERE status NOT IN ('purchase', 'click')")
def _(spark, d):
    e = table(spark, d, "events")
    log = pixels.last_wins(e, "user_id", "event_id").withColumnRenamed("event_type", "status")
    return pixels.open_chunks(e.select("user_id").distinct(), log, "user_id", ("purchase", "click"))


@query("status_counts", "SELECT event_type AS status, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) GROUP BY 1 UNION ALL SELECT 'pending', 0")
def _(spark, d):
    log = pixels.last_wins(table(spark, d, "events"), "user_id", "event_id").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    zero = spark.createDataFrame([("pending", 0)], "status string, n long")
    return log.unionByName(zero.join(log, "status", "left_anti"))


@query("utm_zones", f"WITH {FIXES} SELECT event_id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS BIGINT) AS epsg FROM fixes")
def _(spark, d):
    return fixes(spark, d).select("event_id", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("dataset_profile", f"WITH {STEPS} SELECT study_id, count(*) AS fixes, count(DISTINCT individual_id) AS animals, CAST(sum(CASE WHEN dt_s > 10800 THEN 1 ELSE 0 END) AS BIGINT) AS gaps_3h, CAST(sum(CASE WHEN dt_s > 21600 THEN 1 ELSE 0 END) AS BIGINT) AS gaps_6h, CAST(sum(CASE WHEN dt_s > 86400 THEN 1 ELSE 0 END) AS BIGINT) AS gaps_24h FROM steps GROUP BY study_id")
def _(spark, d):
    return tracks.profile(fixes(spark, d)).drop("first", "last")


@query("month_coverage", f"WITH {FIXES}, m AS (SELECT date_trunc('month', timestamp) AS month, count(*) AS fixes FROM fixes GROUP BY 1), s AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS scenes FROM orders GROUP BY 1) SELECT strftime(month, '%Y-%m') AS month, fixes, coalesce(scenes, 0) AS scenes FROM m LEFT JOIN s USING (month)")
def _(spark, d):
    m = fixes(spark, d).groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.count("*").alias("fixes"))
    s = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("scenes"))
    return m.join(s, "month", "left").withColumn("scenes", F.coalesce("scenes", F.lit(0)))

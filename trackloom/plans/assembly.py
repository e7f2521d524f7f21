"""Queries of splits, folds, scales, model inputs, scores by window, registries and ledgers; the SQL says the same for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.functions import bands
from trackloom.operators import batches, folds, pixels, rasters, scoring, tracks
from trackloom.operators import covariates as cov
from trackloom.plans.catalogue import DISP, GAP_S, SEGS, SNAP, SPLIT, STEPS, H, L, fixes, r6, snapped, windows
from trackloom.plans.forecasts import CHANGES, WIN, rounded
from trackloom.plans.registry import ORACLE_SQL, query, table
from trackloom.sources import settings
from trackloom.streaming import sessions

KEY = ["individual_id", "seg", "cast(start as long) as start"]


def steps(spark, d):
    return tracks.displacements(windows(spark, d), L)


def segments(spark, d):
    return tracks.segments(fixes(spark, d), GAP_S)


# ---- splits and folds ------------------------------------------------------


FOLLOW = SEGS.partition(" FROM events),")[2]  # the segments, over fixes that SPLIT names already


@query("split_segments_follow", f"{SPLIT},{FOLLOW} SELECT event_id, seg, split FROM segs JOIN s USING (study_id, individual_id)")
def _(spark, d):
    return tracks.follow(segments(spark, d), tracks.split_animals(fixes(spark, d), 0.2, 0.2)).select("event_id", "seg", "split")


LEGACY = f"""WITH {SEGS}, u AS (SELECT DISTINCT study_id, individual_id, seg, individual_id || '/' || seg AS name FROM segs),
k AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY sha256(name || ':7'), name) AS k, count(*) OVER (PARTITION BY study_id) AS n FROM u),
v AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - 2)) AS n_val FROM k),
t AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - n_val - 1)) AS n_test FROM v),
s AS (SELECT study_id, individual_id, seg, CASE WHEN n < 3 THEN 'train' WHEN k <= n_val THEN 'val' WHEN k <= n_val + n_test THEN 'test' ELSE 'train' END AS split FROM t)"""


@query("split_by_segment", f"{LEGACY} SELECT * FROM s")
def _(spark, d):
    return tracks.split_segments(segments(spark, d), 0.2, 0.2)


@query("split_overlaps", f"{LEGACY}, h AS (SELECT study_id, individual_id, bool_or(split = 'train')::INT AS a, bool_or(split = 'val')::INT AS b, bool_or(split = 'test')::INT AS c FROM s GROUP BY 1, 2) SELECT sum(a * b)::BIGINT AS train_val, sum(a * c)::BIGINT AS train_test, sum(b * c)::BIGINT AS val_test FROM h")
def _(spark, d):
    return tracks.overlaps(tracks.split_segments(segments(spark, d), 0.2, 0.2))


def dealt_folds(spark, d):
    return folds.balanced_folds(fixes(spark, d).groupBy("study_id", "individual_id").agg(F.count("*").alias("n")), 5)


DEALT = "SELECT study_id, individual_id, fold FROM (" + ORACLE_SQL["kfold_balanced"] + ")"


@query("kfold_all", f"WITH f AS ({DEALT}) SELECT study_id, individual_id, fold, k, CASE WHEN fold = k THEN 'test' WHEN fold = (k + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM f, range(5) r(k)")
def _(spark, d):
    return folds.all_roles(dealt_folds(spark, d), 5).select("study_id", "individual_id", "fold", F.col("k").cast("long").alias("k"), "role")


@query("kfold_tail", f"WITH f AS ({DEALT}), t AS ({ORACLE_SQL['tail_roles']}), e AS (SELECT event_id, 'u' || user_id AS individual_id FROM events) SELECT event_id, CASE WHEN fold = 1 THEN 'test' ELSE t.role END AS role FROM e JOIN f USING (individual_id) JOIN t USING (event_id)")
def _(spark, d):
    x = fixes(spark, d)
    return folds.tail_roles(x, dealt_folds(spark, d), tracks.tail_cuts(x, 0.15), 1).select("event_id", "role")


# ---- scales and model inputs -----------------------------------------------

EVEN = f"""{DISP}, w AS (SELECT study_id, individual_id, seg, start, row_number() OVER (ORDER BY study_id, individual_id, seg, start) - 1 AS k, count(*) OVER () AS n FROM disp WHERE pos = 0),
few AS (SELECT w.* FROM w WHERE k IN (SELECT (i * (n - 1)) // greatest(least(n, 200) - 1, 1) FROM range(200) r(i), (SELECT count(*) AS n FROM w) WHERE i < least(n, 200)))"""
RMS = f"(SELECT sqrt(avg((dx * dx + dy * dy) / 2)) FROM disp JOIN few USING (study_id, individual_id, seg, start) WHERE pos >= {L})"


@query("target_scale", f"WITH {EVEN} SELECT round({RMS}, 4) AS target_scale")
def _(spark, d):
    return rounded(batches.target_scale(batches.evenly(steps(spark, d), 200), L), 4, "target_scale")


@query("change_scales", f"WITH {CHANGES} SELECT round(stddev_pop(a), 4) AS anomaly_std, round(stddev_pop(s), 4) AS step_change_std FROM g")
def _(spark, d):
    x = steps(spark, d).where(F.col("pos") < L).withColumn("v", F.when((F.col("start") + F.col("pos")) % 5 != 0, F.col("x")))
    return rounded(cov.change_scales(cov.changes(x, WIN, "pos", "v")), 4, "anomaly_std", "step_change_std")


@query("unscaled", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax FROM lineitem")
def _(spark, d):
    cols = ["l_quantity", "l_tax"]
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    s = cov.scaler(x, cols)
    z = x.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", *(((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in cols))  # one row
    return r6(cov.unscaled(z, s, cols), *cols)


@query("width_spec", f"WITH {DISP}, w AS (SELECT count(*) AS n FROM disp WHERE pos = 0 AND study_id = 'study_1') SELECT 2::BIGINT AS n_covariates, 4::BIGINT AS n_time_features, round(sqrt(avg((dx * dx + dy * dy) / 2)), 4) AS target_scale, any_value(n) AS val_windows, any_value(n) < 200 AS small_validation FROM disp, w WHERE pos >= {L} AND study_id = 'study_0'")
def _(spark, d):
    x = steps(spark, d)
    out = batches.width_spec(x.where("study_id = 'study_0'"), x.where("study_id = 'study_1'"), L, ["ndvi", "snow"], 4)
    return rounded(out, 4, "target_scale").select(F.col("n_covariates").cast("long").alias("n_covariates"), F.col("n_time_features").cast("long").alias("n_time_features"), "target_scale", "val_windows", "small_validation")


@query("batch_rows", f"""WITH {DISP} SELECT individual_id, seg, start, count(*) FILTER (pos < {L}) AS n_x, count(*) FILTER (pos >= {L}) AS n_y, round(sum((pos + 1) * dx) FILTER (pos < {L}), 2) AS x_dx, round(sum((pos + 1) * dy) FILTER (pos >= {L}), 2) AS y_dy,
round((max(epoch_us(timestamp)) FILTER (pos = {L - 1}) - min(epoch_us(timestamp))) / 1e6, 3) AS dt_last FROM disp GROUP BY study_id, individual_id, seg, start""")
def _(spark, d):
    x = batches.assembled(steps(spark, d), L, ["dx", "dy"])
    dot = lambda a, k, at: F.round(F.expr(f"aggregate(transform({a}, (r, i) -> (i + 1 + {at}) * r[{k}]), 0d, (s, v) -> s + v)"), 2)
    return x.selectExpr("x", "y", "dt", *KEY).select("individual_id", "seg", "start", F.size("x").cast("long").alias("n_x"), F.size("y").cast("long").alias("n_y"), dot("x", 0, 0).alias("x_dx"), dot("y", 1, L).alias("y_dy"), F.round(F.element_at("dt", -1), 3).alias("dt_last"))


@query("time_encoding", f"SELECT event_id, {', '.join(f'round({f}(value * {math.exp(-math.log(10000.0) * i / 6)!r}), 6) AS e{i + j}' for i in (0, 2, 4) for j, f in enumerate(('sin', 'cos')))} FROM events")
def _(spark, d):
    x = table(spark, d, "events").select("event_id", batches.time_encoding(F.col("value"), 6).alias("e"))
    return x.select("event_id", *(F.round(F.col("e")[i], 6).alias(f"e{i}") for i in range(6)))


@query("gate_mean", "SELECT round(avg(1 / (1 + exp(-(l_tax * 100 - 4)))), 6) AS gate FROM lineitem")
def _(spark, d):
    return r6(batches.gate_mean(table(spark, d, "lineitem").select((F.col("l_tax") * 100 - 4).alias("z")), "z"), "gate")


# ---- scores ----------------------------------------------------------------


@query("window_scores", f"""WITH {DISP}, f AS (SELECT *, row_number() OVER () AS i, step * vx AS px, step * vy AS py FROM errs), m AS (SELECT f.*, m, px * (1 + m / 10.0) AS sx, py * (1 - m / 10.0) AS sy FROM f, range(4) r(m)),
a AS (SELECT i, avg(sqrt(pow(sx - x, 2) + pow(sy - y, 2) + 1e-9)) AS a FROM m GROUP BY i), b AS (SELECT p.i, sum(sqrt(pow(p.sx - q.sx, 2) + pow(p.sy - q.sy, 2) + 1e-9)) / 24 AS b FROM m p JOIN m q ON p.i = q.i GROUP BY p.i)
SELECT individual_id, seg, start, min(epoch_us(timestamp)) AS t_origin, round(avg(a - b), 3) AS es, round(avg(sqrt(pow(x - px, 2) + pow(y - py, 2))), 3) AS ade, round(max(CASE WHEN step = {H} THEN sqrt(pow(x - px, 2) + pow(y - py, 2)) END), 3) AS fde, round(avg(cp_m), 3) AS ade_cp
FROM f JOIN a USING (i) JOIN b USING (i) GROUP BY study_id, individual_id, seg, start""")
def _(spark, d):
    x = scoring.baseline_errors(steps(spark, d), L).withColumn("px", F.col("step") * F.col("vx")).withColumn("py", F.col("step") * F.col("vy"))
    x = x.withColumn("samples", F.expr("transform(sequence(0, 3), m -> struct(px * (1 + m / 10d) as x, py * (1 - m / 10d) as y))"))
    return rounded(batches.window_scores(x, "samples"), 3, "es", "ade", "fde", "ade_cp").selectExpr(*KEY, "unix_micros(t_origin) as t_origin", "es", "ade", "fde", "ade_cp")


@query("no_skill", f"WITH {DISP} SELECT round(avg(cp_m), 4) AS ade_cp, round(avg(cp_m) FILTER (step = {H}), 4) AS fde_cp, round(avg(cv_m), 4) AS ade_cv, round(avg(cv_m) FILTER (step = {H}), 4) AS fde_cv, round(avg(cp_m), 4) AS es_cp FROM errs")
def _(spark, d):
    return rounded(batches.no_skill(scoring.baseline_errors(steps(spark, d), L), H), 4, "ade_cp", "fde_cp", "ade_cv", "fde_cv", "es_cp")


# ---- registry, ledger, rasters ---------------------------------------------

REGISTRY = {
    "export": {"destination": "drive"}, "datasets": {},
    "sources": {
        "greenness": {"asset": "a", "kind": "image_collection", "cadence": "composite", "composite_days": 8, "tier": 1, "bands": ["B4", "B8"], "grid": {"mode": "utm", "res": [10, 10]}, "derived": [{"name": "ndvi", "expr": "(b('B8') - b('B4')) / (b('B8') + b('B4'))"}], "class_fractions": [{"name": "snow", "band": "SCL", "classes": [11]}], "temporal_rates": [{"name": "ndvi_rate", "band": "ndvi"}], "reducers": ["first", "mean"]},
        "relief": {"asset": "b", "kind": "image", "cadence": "static", "scale_m": 30, "bands": ["elevation"], "grid": {"mode": "fixed", "crs": "EPSG:4326", "res": [1, 1]}, "terrain": ["slope", "aspect", "hillshade"]},
    },
}


@query("registry_columns", "SELECT * FROM (VALUES ('greenness', 0, 'B4'), ('greenness', 1, 'B8'), ('greenness', 2, 'ndvi'), ('greenness', 3, 'snow'), ('greenness', 4, 'ndvi_rate'), ('relief', 0, 'elevation'), ('relief', 1, 'slope'), ('relief', 2, 'aspect')) t(source, place, band)")
def _(spark, d):
    return settings.registry(REGISTRY).table(spark).select("source", F.posexplode("columns").alias("place", "band"))


STATUSES = ("complete", "failed", "pending", "running", "submitted")


@query("ledger_status", f"SELECT s AS status, count(user_id) AS n FROM (SELECT unnest({list(STATUSES)!r}) AS s) LEFT JOIN (SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'running' ELSE 'failed' END AS t FROM events GROUP BY 1) ON s = t GROUP BY s")
def _(spark, d):
    last = pixels.last_wins(table(spark, d, "events"), "user_id", "event_id")
    return pixels.status_counts(last.select(F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "running").otherwise("failed").alias("status")), STATUSES)


@query("ledger_moves", """WITH l AS (SELECT o_orderkey AS chunk_id, CASE o_orderkey % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'running' ELSE 'complete' END AS status FROM orders),
s AS (SELECT o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' END AS new, o_orderstatus FROM orders WHERE o_custkey % 4 <> 0)
SELECT chunk_id, new AS status, CASE WHEN new = 'failed' THEN 'FAILED' END AS failure_reason FROM l JOIN s USING (chunk_id) WHERE l.status <> 'complete' AND new IS NOT NULL AND new <> l.status""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    ledger = o.select(k.alias("chunk_id"), F.concat(F.lit("t"), k).alias("task_id"), F.when(k % 3 == 0, "submitted").when(k % 3 == 1, "running").otherwise("complete").alias("status"))
    state = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("LOST")
    now = o.where("o_custkey % 4 <> 0").select(F.concat(F.lit("t"), k).alias("task_id"), state.alias("state"), F.lit(None).cast("string").alias("error_message"))
    return sessions.moves(ledger, now, F.current_timestamp()).select("chunk_id", "status", "failure_reason")


@query("plan_summary", f"WITH {SNAP}, c AS ({ORACLE_SQL['chunk_packing']}) SELECT count(*) AS fixes, count(DISTINCT (px_row, px_col, t0)) AS keys, count(DISTINCT (px_row, px_col)) AS pixels, count(DISTINCT t0) AS buckets, (SELECT count(*) FROM c) AS chunks, round((SELECT avg(n_keys) FROM c), 4) AS mean_features FROM snap")
def _(spark, d):
    x = snapped(spark, d).withColumn("bucket", F.col("t0").cast("string"))
    chunks = folds.pack_chunks(x.select((F.col("px_col") % 3).alias("zone"), "bucket", "t0"), 150, 4)
    return pixels.plan_summary(x, x, chunks).select("fixes", "keys", "pixels", "buckets", "chunks", F.round("mean_features", 4).alias("mean_features"))


@query("cadence_filters", f"""WITH {STEPS}, r AS (SELECT event_id, pt AS a, timestamp AS b, date_diff('day', CAST(timestamp AS DATE), CAST(pt AS DATE)) AS d FROM steps WHERE pt IS NOT NULL)
SELECT event_id, true AS static, year(a) = least(year(b), 2024) AS annual, date_trunc('month', a) = date_trunc('month', b) AS monthly, CAST(a AS DATE) = CAST(b AS DATE) AS daily, date_trunc('hour', a) = date_trunc('hour', b) AS hourly, d >= -1 AND d < 1 AS composite FROM r""")
def _(spark, d):
    x = tracks.with_steps(fixes(spark, d))
    w = F.lag("timestamp").over(tracks.Window.partitionBy(*tracks.ANIMAL).orderBy("timestamp"))
    x = x.withColumn("a", w).where("a is not null")
    return x.select("event_id", *(rasters.cadence_window(F.col("a"), F.col("timestamp"), c, 1, 2024).alias(c) for c in ("static", "annual", "monthly", "daily", "hourly", "composite")))


@query("qa_masks", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (3, 5) AND coalesce(CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END, 100) < 40 THEN l_tax END AS scene, CASE WHEN l_partkey & 3 <= 0 AND (l_suppkey >> 1) & 3 <= 1 THEN l_tax END AS day_night, CASE WHEN l_quantity <= 30 THEN l_tax END AS valid, CASE WHEN l_linenumber > 2 THEN l_tax END AS covered FROM lineitem""")
def _(spark, d):
    c = F.col
    prob = F.when(c("l_partkey") % 5 != 0, c("l_quantity"))
    clear = bands.bits_clear(c("l_partkey"), 0, 1) & bands.bits_clear(c("l_suppkey"), 1, 2, 1)
    oks = {"scene": bands.scene_class_mask(c("l_linenumber"), prob, (3, 5), 40.0), "day_night": clear, "valid": c("l_quantity") <= 30, "covered": c("l_linenumber") > 2}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(bands.masked(c("l_tax"), ok).alias(n) for n, ok in oks.items()))


@query("terrain_aspect", "WITH m AS (SELECT hour(ts) AS r, day(ts) AS c, avg(sqrt(value)) AS v FROM events GROUP BY 1, 2), n AS (SELECT a.r, a.c, b.v, b.r - a.r AS y, b.c - a.c AS x FROM m a JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1), g AS (SELECT r, c, count(*) AS n, sum(v * x * CASE WHEN x = 0 OR y = 0 THEN 2 ELSE 1 END) / 800 AS gx, sum(v * y * CASE WHEN x = 0 OR y = 0 THEN 2 ELSE 1 END) / 800 AS gy FROM n GROUP BY r, c) SELECT r AS px_row, c AS px_col, round(cos(atan2(-gx, gy)), 5) AS east, round(sin(atan2(-gx, gy)), 5) AS north FROM g WHERE n = 9")
def _(spark, d):
    x = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("px_row"), F.dayofmonth("ts").cast("long").alias("px_col")).agg(F.avg(F.sqrt("value")).alias("v"))
    a = F.radians("aspect")
    return rasters.terrain(x, "v", 100.0).select("px_row", "px_col", F.round(F.cos(a), 5).alias("east"), F.round(F.sin(a), 5).alias("north"))


@query("dataset_spans", f"WITH {STEPS} SELECT study_id, min(epoch_us(timestamp)) AS first, max(epoch_us(timestamp)) AS last, count(*) AS fixes FROM steps GROUP BY study_id")
def _(spark, d):
    at = lambda c: F.unix_micros(F.to_timestamp(c)).alias(c)
    return tracks.profile(fixes(spark, d)).select("study_id", at("first"), at("last"), "fixes")


@query("poll_waits", "SELECT event_id, least(30 * pow(1.5, event_id % 12), 600) AS wait_s FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sessions.backoff(F.col("event_id") % 12, 30.0, 600.0, 1.5).alias("wait_s"))

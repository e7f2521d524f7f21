"""Queries of per-source products, rasters, registries, trials and whole windows; the SQL says the same for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.functions import projection

from trackloom.operators import pixels, products, scoring, tracks, trials
from trackloom.plans.catalogue import DISP, FIXES, GAP_S, SNAP, WINS, H, L, fixes, order_fixes, r6, snapped, windows
from trackloom.plans.registry import ORACLE_SQL, query, table

KEYED = f"{SNAP}, keyed AS (SELECT *, dense_rank() OVER (ORDER BY px_row, px_col, t0) - 1 AS key_index FROM snap)"


def r3(df, *names):
    return df.withColumns({n: F.round(F.col(n), 3) for n in names})


# ---- per-source products ---------------------------------------------------


@query("fix_table", f"""WITH {KEYED}, v AS (SELECT event_id, timestamp, CASE WHEN key_index % 4 <> 0 AND key_index % 10 <> 1 THEN key_index % 97 / 2 END AS ndvi, CASE WHEN key_index % 4 <> 0 THEN key_index % 13 END AS buf, CASE WHEN key_index % 4 <> 0 THEN key_index % 5 END AS scenes FROM keyed)
SELECT event_id AS fix_id, 'events' AS dataset, epoch_us(timestamp) AS t, round(CAST(ndvi AS DOUBLE), 6) AS ndvi, CAST(buf AS DOUBLE) AS ndvi_buf30, ndvi IS NULL AS ndvi_missing, CAST(scenes AS DOUBLE) AS n_scenes, round(abs(epoch_us(timestamp) - epoch_us(date_trunc('day', timestamp) + INTERVAL 12 HOUR)) / 3.6e9, 6) AS age FROM v""")
def _(spark, d):
    x = snapped(spark, d).withColumn("fix_id", F.col("event_id"))
    keys = pixels.number_keys(pixels.keys_of(x))
    k = F.col("key_index")
    # An export: text, with a key left out now and then and a value that isn't a number.
    sampled = keys.where(k % 4 != 0).select("key_index", F.when(k % 10 == 1, "n/a").otherwise((k % 97 / 2).cast("string")).alias("ndvi"), (k % 13).cast("string").alias("ndvi_buf30"), (k % 5).alias("n_scenes"))
    t = F.col("timestamp")
    age = F.abs(F.unix_micros(t) - F.unix_micros(pixels.nominal_time(t, "daily").cast("timestamp"))) / 3.6e9
    out = products.fix_table(x, x.join(keys, list(pixels.KEY)).select("fix_id", "key_index"), sampled, ["ndvi", "evi"], "events", age)
    return r6(out.select("fix_id", "dataset", F.unix_micros("timestamp").alias("t"), "ndvi", "ndvi_buf30", "ndvi_missing", "n_scenes", F.col("_age_hours").alias("age")), "ndvi", "age")


@query("unmatched_fixes", f"WITH {KEYED} SELECT count(*) AS unmatched FROM keyed WHERE key_index % 4 = 0")
def _(spark, d):
    x = snapped(spark, d)
    keys = pixels.number_keys(pixels.keys_of(x))
    return products.unmatched(x.join(keys, list(pixels.KEY)), keys.where("key_index % 4 <> 0"))


@query("completed_chunks", "SELECT user_id AS chunk_id, min(event_id) AS place FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'purchase' AND user_id % 2 = 0")
def _(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("chunk_id"), F.when(F.col("event_type") == "purchase", "complete").otherwise("submitted").alias("status"), F.col("event_id").alias("seq"))
    return products.completed(log, e.select(F.col("user_id").alias("chunk_id")).where("chunk_id % 2 = 0").distinct())


@query("reduction_guard", f"""WITH {FIXES}, s AS (SELECT cell, scale, CAST(floor((lon + 180.0) / cell) AS BIGINT) AS c, CAST(floor((90.0 - lat) / cell) AS BIGINT) AS r, CAST(timestamp AS DATE) AS t0 FROM fixes, (VALUES (0.00001, 10.0), (0.00001, 1000.0), (0.1, 10000.0)) g(cell, scale)),
x AS (SELECT scale, count(*) AS fixes, count(DISTINCT (r, c, t0)) AS keys, count(DISTINCT (r, c)) AS pixels FROM s GROUP BY scale)
SELECT scale, fixes, keys, pixels, CASE WHEN scale > 30 AND pixels / fixes > 0.5 THEN 'fail' WHEN keys / fixes > 0.9 THEN 'warn' ELSE 'ok' END AS verdict FROM x""")
def _(spark, d):
    out = None
    for cell, scale in ((0.00001, 10.0), (0.00001, 1000.0), (0.1, 10000.0)):
        x = pixels.snap(fixes(spark, d), cell).withColumn("t0", pixels.time_key(F.col("timestamp"), "daily"))
        x = products.reduction_verdict(pixels.reduction(x), scale).select(F.lit(scale).alias("scale"), "fixes", "keys", "pixels", "verdict")
        out = x if out is None else out.unionByName(x)
    return out


@query("version_guard", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'v2' ELSE 'v1' END AS representation, l_returnflag = 'N' AS usable FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "v2").when(F.col("l_returnflag") == "A", "v1").alias("representation"))
    return products.check_version(x, "v2", "v1")


# ---- rasters and registry --------------------------------------------------


@query("raster_samples", f"""WITH {SNAP}, px AS (SELECT px_row, px_col, t0, avg(event_id) AS v FROM snap WHERE event_id % 3 <> 0 GROUP BY ALL), p AS (SELECT * FROM snap WHERE event_id % 3 = 0),
b AS (SELECT k.px_row, k.px_col, k.t0, avg(v) AS buf FROM (SELECT DISTINCT px_row, px_col, t0 FROM p) k JOIN px ON px.t0 = k.t0 AND abs(px.px_row - k.px_row) <= 1 AND abs(px.px_col - k.px_col) <= 1 GROUP BY ALL)
SELECT event_id, round(v, 6) AS v, round(buf, 6) AS v_buf30 FROM p LEFT JOIN px USING (px_row, px_col, t0) LEFT JOIN b USING (px_row, px_col, t0)""")
def _(spark, d):
    x = snapped(spark, d)
    raster = x.where("event_id % 3 <> 0").groupBy(*pixels.KEY).agg(F.avg("event_id").alias("v"))
    return r6(products.sample_pixels(x.where("event_id % 3 = 0"), raster, ["v"], buffer=1).select("event_id", "v", "v_buf30"), "v", "v_buf30")


@query("scene_pairs", "SELECT l_orderkey, l_linenumber, round(min_by(o_totalprice, o_orderkey), 2) AS cloud FROM (SELECT row_number() OVER () AS i, * FROM lineitem) l JOIN orders ON o_custkey = l_suppkey WHERE l_returnflag = 'A' AND list_contains(['O', 'F'], l_linestatus) GROUP BY i, l_orderkey, l_linenumber")
def _(spark, d):
    scenes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("index"), "l_returnflag", F.array("l_linestatus").alias("polarisations"))
    probs = table(spark, d, "orders").select(F.col("o_custkey").alias("index"), "o_orderkey", F.round("o_totalprice", 2).alias("cloud"))
    wanted = (F.col("l_returnflag") == "A") & (F.array_contains("polarisations", "O") | F.array_contains("polarisations", "F"))
    return products.pair_scenes(scenes, probs, "index", "o_orderkey", wanted).select("l_orderkey", "l_linenumber", "cloud")


@query("band_scaling", "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.0001, 8) AS B8, round(l_tax * 0.02, 8) AS lst FROM lineitem")
def _(spark, d):
    x = products.scale_bands(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("B8"), F.col("l_tax").alias("lst")), {"B8": 0.0001, "lst": 0.02})
    return x.withColumns({c: F.round(c, 8) for c in ("B8", "lst")})


@query("source_selection", "WITH t AS (SELECT n_name, n_regionkey FROM nation), p AS (SELECT n_name, 0 AS part, n_name AS o FROM t WHERE n_regionkey = 2 UNION ALL SELECT 'NATION_3', 1, '' UNION ALL SELECT n_name, 2, n_name FROM t), f AS (SELECT n_name, min((part, o)) AS k FROM p GROUP BY n_name) SELECT row_number() OVER (ORDER BY k) - 1 AS place, n_name AS name FROM f")
def _(spark, d):
    known = {r["n_name"]: r["n_regionkey"] for r in table(spark, d, "nation").collect()}  # a registry
    return spark.createDataFrame(list(enumerate(products.select_names(known, "tier2, NATION_3, all"))), "place long, name string")


@query("buffer_reducers", "SELECT p_partkey, CASE WHEN p_size <= 30 AND p_brand <> 'Brand#13' THEN CASE WHEN p_type LIKE 'ECONOMY%' THEN 'mode' ELSE 'mean' END END AS reducer FROM part")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("scale_m"), F.when(F.col("p_brand") == "Brand#13", F.array(F.lit("first"))).otherwise(F.array(F.lit("first"), F.lit("mean"))).alias("reducers"), F.col("p_type").startswith("ECONOMY").alias("categorical"))
    return products.buffer_reducers(x).select("p_partkey", "reducer")


# ---- windows ---------------------------------------------------------------


@query("strided_windows", f"WITH {WINS} SELECT individual_id, seg, start, round(sum(lat), 6) AS lat_sum, max(epoch_us(timestamp)) AS t_last FROM wins WHERE start % 4 = 0 GROUP BY study_id, individual_id, seg, start")
def _(spark, d):
    x = tracks.sliding_windows(tracks.segments(fixes(spark, d), GAP_S), L, H, stride=4)
    return x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.round(F.expr("aggregate(window, 0d, (s, p) -> s + p.lat)"), 6).alias("lat_sum"), F.unix_micros(F.col("window")[L + H - 1]["timestamp"]).alias("t_last"))


@query("elapsed_seconds", f"WITH {WINS} SELECT individual_id, seg, start, pos, round((epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY study_id, individual_id, seg, start))) / 1e6, 3) AS elapsed_s FROM wins")
def _(spark, d):
    x = tracks.elapsed(windows(spark, d))
    return r3(x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), "elapsed_s"), "elapsed_s")


@query("histories", "SELECT o_custkey AS individual, min(o_orderkey) AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS k FROM orders GROUP BY o_custkey, o_orderdate")
def _(spark, d):
    return tracks.histories(order_fixes(spark, d)).select(F.col("individual_id").cast("long").alias("individual"), "event_id", F.col("k").cast("long").alias("k"))


@query("augmented_windows", f"""WITH {DISP}, a AS (SELECT *, md5(study_id || ':' || individual_id || ':' || seg || ':' || start || ':3') AS h FROM disp),
t AS (SELECT *, ('0x' || h[1:12])::BIGINT / 281474976710656.0 * 2 * pi() AS a, CASE WHEN ('0x' || h[13:13])::BIGINT < 8 THEN -dx ELSE dx END AS mx FROM a)
SELECT individual_id, seg, start, pos, round(mx * cos(a) - dy * sin(a), 3) AS dx, round(mx * sin(a) + dy * cos(a), 3) AS dy FROM t""")
def _(spark, d):
    x = tracks.rotated(tracks.displacements(windows(spark, d), L), ["study_id", "individual_id", "seg", "start"])
    return r3(x.select("individual_id", "seg", F.col("start").cast("long").alias("start"), F.col("pos").cast("long").alias("pos"), "dx", "dy"), "dx", "dy")


@query("horizon_table", f"WITH {DISP} SELECT step, round(avg(cp_m), 4) AS ade, round(sqrt(avg((x * x + y * y) / 2)), 4) AS rmse, round(avg((abs(x) + abs(y)) / 2), 4) AS mae FROM errs GROUP BY step")
def _(spark, d):
    x = trials.horizon_table(scoring.baseline_errors(tracks.displacements(windows(spark, d), L), L))
    return x.select(F.col("step").cast("long").alias("step"), *(F.round(c, 4).alias(c) for c in ("ade", "rmse", "mae")))


@query("metrics_report", f"WITH {DISP} SELECT round(avg(cp_m), 4) AS ade, round(avg(cp_m) FILTER (step = {H}), 4) AS fde, round(sqrt(avg((x * x + y * y) / 2)), 4) AS rmse, round(avg((abs(x) + abs(y)) / 2), 4) AS mae, count(*) FILTER (step = {H}) AS n_windows FROM errs")
def _(spark, d):
    x = trials.metrics_report(scoring.baseline_errors(tracks.displacements(windows(spark, d), L), L), H)
    return x.select(*(F.round(c, 4).alias(c) for c in ("ade", "fde", "rmse", "mae")), "n_windows")


# ---- trials ----------------------------------------------------------------

SCALED = "s AS (SELECT dt_h, CAST(least(128, greatest(2, round_even(24 / greatest(dt_h, 0.25), 0))) AS BIGINT) AS input_len, CAST(least(64, greatest(1, round_even(12 / greatest(dt_h, 0.25), 0))) AS BIGINT) AS horizon FROM (SELECT DISTINCT l_quantity / 40 AS dt_h FROM lineitem))"


@query("window_overrides", f"WITH {SCALED}, t AS (SELECT *, greatest(1, least(input_len, CAST(round_even(0.25 / dt_h, 0) AS BIGINT))) AS stride FROM s) SELECT dt_h, input_len, horizon, stride, horizon AS eval_stride, CASE WHEN stride > 1 THEN 25.0::DOUBLE END AS max_speed_mps FROM t")
def _(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 40).alias("dt_h")).distinct()
    return trials.window_overrides(tracks.window_scaling(x)).drop("gap_multiplier")


@query("forcing_ratio", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS e, CASE l_returnflag WHEN 'A' THEN 'constant' WHEN 'N' THEN 'linear' ELSE 'inverse_sigmoid' END AS mode FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, mode, round(least(1, greatest(0, CASE mode WHEN 'constant' THEN 0.9 WHEN 'linear' THEN 0.9 * (1 - least(1.0, e / 30)) ELSE 0.9 / (1 + exp(CAST(e - 30 AS DOUBLE))) END)), 9) AS ratio FROM m""")
def _(spark, d):
    mode = F.when(F.col("l_returnflag") == "A", "constant").when(F.col("l_returnflag") == "N", "linear").otherwise("inverse_sigmoid")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("e"), mode.alias("mode"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "mode", F.round(trials.forcing_ratio(F.col("e"), F.col("mode"), 0.9, 30), 9).alias("ratio"))


@query("search_samples", f"""WITH u AS (SELECT p_partkey, ('0x' || md5('lr:' || p_partkey || ':1')[1:12])::BIGINT / 281474976710656.0 AS a, ('0x' || md5('width:' || p_partkey || ':1')[1:12])::BIGINT / 281474976710656.0 AS b FROM part)
SELECT p_partkey, round(pow(10.0, {math.log10(1e-4)} + a * ({math.log10(1e-2)} - {math.log10(1e-4)})), 9) AS lr, [16, 32, 64, 96][CAST(floor(b * 4) AS BIGINT) + 1] AS width FROM u""")
def _(spark, d):
    u = lambda axis: trials.unit_draw(F.lit(axis), F.col("p_partkey"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.round(trials.log_uniform(u("lr"), 1e-4, 1e-2), 9).alias("lr"), trials.choice(u("width"), [16, 32, 64, 96]).alias("width"))


@query("trial_costs", """WITH k AS (SELECT s_nationkey AS dataset, min(s_acctbal) + 1000 AS w, min(s_suppkey) + 100 AS p, max(s_acctbal) / 10 AS v, 24 AS len FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1),
t AS (SELECT c_custkey, c_nationkey AS dataset, CASE WHEN c_custkey % 4 = 0 THEN 'tcn' ELSE 'lstm' END AS arm, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey + 50 END AS params, c_custkey % 128 + 1 AS input_len FROM customer)
SELECT c_custkey, arm, round(coalesce(w, 200) * (coalesce(params, p, 1) / coalesce(p, 1)), 4) AS wall_s, round(coalesce(v, 0) * (coalesce(params, p, 1) / coalesce(p, 1)) * CASE WHEN arm = 'tcn' THEN input_len / coalesce(len, 24) ELSE 1 END, 4) AS vram_mb FROM t LEFT JOIN k USING (dataset)""")
def _(spark, d):
    k = table(spark, d, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("dataset"))
    k = k.agg((F.min("s_acctbal") + 1000).alias("ref_wall"), (F.min("s_suppkey") + 100).alias("ref_params"), (F.max("s_acctbal") / 10).alias("ref_vram"), F.lit(24).alias("ref_len"))
    c = F.col("c_custkey")
    t = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dataset"), F.when(c % 4 == 0, "tcn").otherwise("lstm").alias("arm"), F.when(c % 5 != 0, c + 50).alias("params"), (c % 128 + 1).alias("input_len"))
    return trials.costs(t, k, ["dataset"]).select("c_custkey", "arm", F.round("wall_s", 4).alias("wall_s"), F.round("vram_mb", 4).alias("vram_mb"))


MARKS = " OR ".join(f"contains(m, '{x}')" for x in trials.TRANSIENT)
WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in trials.STATES.items())
MESSAGES = ("HTTP {} from the server", "Deadline Exceeded after {} s", "no such band B{}", "Quota: {} left")
NAMES = [*trials.STATES, "UNKNOWN"]


@query("task_outcomes", f"""WITH e AS (SELECT event_id, lower(CASE event_id % 4 {' '.join(f"WHEN {i} THEN '{m.replace('{}', "' || (event_id % 700) || '")}'" for i, m in enumerate(MESSAGES))} END) AS m, {NAMES!r}[event_id % {len(NAMES)} + 1] AS state FROM events)
SELECT event_id, {MARKS} AS transient, CASE state {WORDS} END AS status FROM e""")
def _(spark, d):
    e, n = table(spark, d, "events"), (F.col("event_id") % 700).cast("string")
    text = F.lit(None).cast("string")
    for i, m in enumerate(MESSAGES):
        a, b = m.split("{}")
        text = F.when(F.col("event_id") % 4 == i, F.concat(F.lit(a), n, F.lit(b))).otherwise(text)
    state = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return e.select("event_id", trials.is_transient(text).alias("transient"), trials.task_status(state).alias("status"))


@query("unit_order", "WITH u AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE 'fold' || c_custkey % 40 END AS label FROM customer), k AS (SELECT label, regexp_replace(label, '[0-9]+$', '') AS prefix, coalesce(try_cast(regexp_replace(label, '[^0-9]', '', 'g') AS BIGINT), 0) AS number FROM u) SELECT label, prefix, number, row_number() OVER (ORDER BY prefix, number) AS place FROM k")
def _(spark, d):
    c = F.col("c_custkey")
    u = table(spark, d, "customer").select(F.when(c % 7 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("fold"), c % 40)).alias("label")).distinct().withColumn("k", trials.unit_key(F.col("label")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("k")).cast("long")  # units of a study are few
    return u.select("label", "k.prefix", "k.number", place.alias("place"))


CONFIG = "sha256('{\"arm\":\"' || l_returnflag || '\",\"lr\":' || l_linenumber || ',\"unit\":' || l_suppkey || '}')"


@query("open_trials", f"WITH t AS (SELECT DISTINCT l_returnflag, l_linenumber, l_suppkey, {CONFIG} AS config_hash FROM lineitem), done AS (SELECT DISTINCT {CONFIG} AS config_hash FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45) SELECT l_returnflag AS arm, l_linenumber AS lr, l_suppkey AS unit, config_hash FROM t WHERE config_hash NOT IN (SELECT config_hash FROM done)")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("lr"), F.col("l_suppkey").alias("unit"), "l_linestatus", "l_quantity")
    done = x.withColumn("config_hash", trials.config_hash(["arm", "lr", "unit"])).withColumn("status", F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "complete").otherwise("failed"))
    return trials.open_trials(x.select("arm", "lr", "unit").distinct(), done, ["arm", "lr", "unit"])


@query("merged_trials", """WITH a AS (SELECT o_custkey AS trial, 0 AS log, o_orderkey AS seq, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 6 = 1),
m AS (SELECT trial, arg_max(s, (log, seq)) AS s, arg_max(v, (log, seq)) AS v FROM a GROUP BY trial),
r AS (SELECT s_suppkey AS trial, s_acctbal AS ade, s_nationkey % 2 = 0 AS ended FROM supplier)
SELECT trial, CASE WHEN s = 'F' AND coalesce(ended, false) THEN 'complete' WHEN s = 'F' THEN 'failed' ELSE 'running' END AS status, round(coalesce(ade, v), 4) AS ade FROM m LEFT JOIN r USING (trial)""")
def _(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("trial"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"), F.col("o_totalprice").alias("ade"))
    last = trials.merged([x.where("seq % 2 = 0"), x.where("seq % 6 = 1")], "trial", "seq")
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trial"), F.col("s_acctbal").alias("ade"), (F.col("s_nationkey") % 2 == 0).alias("ended"))
    return trials.updated(last, r, "trial", ["ade"]).select("trial", "status", F.round("ade", 4).alias("ade"))


@query("filled_climatology", "SELECT o_orderkey, round(first_value(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS es_clim FROM orders")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("es_clim"))
    return trials.filled(x, "o_custkey", "o_orderkey", ["es_clim"]).select("o_orderkey", F.round("es_clim", 4).alias("es_clim"))


@query("paired_windows", """WITH w AS (SELECT o_custkey % 5 AS fold, CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'cov' END AS arm, o_orderkey % 3 AS run, o_custkey AS ind, o_orderkey, o_totalprice AS es FROM orders WHERE o_custkey % 5 <> 3 OR o_orderkey % 2 = 0),
l AS (SELECT * FROM w WHERE run = (SELECT max(run) FROM w v WHERE v.fold = w.fold AND v.arm = w.arm)),
f AS (SELECT fold FROM l GROUP BY fold HAVING count(DISTINCT arm) = 2),
p AS (SELECT *, row_number() OVER (PARTITION BY fold, arm, ind ORDER BY o_orderkey) AS place FROM l JOIN f USING (fold))
SELECT a.fold, a.ind, a.place, round(a.es, 4) AS plain_es, round(b.es, 4) AS cov_es FROM p a JOIN p b USING (fold, ind, place) WHERE a.arm = 'plain' AND b.arm = 'cov'""")
def _(spark, d):
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("fold"), F.when(k % 2 == 0, "plain").otherwise("cov").alias("arm"), (k % 3).alias("run"), F.col("o_custkey").alias("ind"), "o_orderkey", F.round("o_totalprice", 4).alias("es"))
    w = trials.latest_runs(w.where("fold <> 3 or arm = 'plain'"), ["fold", "arm"], "run")
    return trials.pair_windows(w, "fold", "arm", ["ind"], "o_orderkey", ["plain", "cov"], ["es"]).withColumn("place", F.col("place").cast("long"))


@query("validation_means", "SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS ade, round(sum(l_discount * l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS es, sum(l_quantity) AS n FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", F.col("l_tax").alias("ade"), F.when(F.col("l_returnflag") == "A", F.col("l_discount")).alias("es"))
    return r6(trials.weighted_means(x, "l_quantity", ["ade", "es"]), "ade", "es")


# ---- SQL of queries that stand elsewhere -----------------------------------

ORACLE_SQL["animal_bootstrap"] = """WITH c AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS m FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS k, count(*) OVER () AS n FROM c),
p AS (SELECT i, ('0x' || md5(i || ':' || k || ':5')[1:12])::BIGINT % n AS k FROM k, range(4000) r(i)),
r AS (SELECT i, sum(s) / sum(m) AS r FROM p JOIN k USING (k) GROUP BY i)
SELECT round(quantile_cont(r, 0.025), 4) AS lo, round(quantile_cont(r, 0.975), 4) AS hi, count(*) AS draws FROM r"""
ORACLE_SQL["key_digest"] = f"""WITH {SNAP}, h AS (SELECT DISTINCT md5(px_row || '|' || px_col || '|' || t0) AS h FROM snap),
s AS (SELECT count(*) AS n, sum(('0x' || h[1:12])::BIGINT) AS a, sum(('0x' || h[13:24])::BIGINT) AS b FROM h)
SELECT n, sha256(n || '|' || a || '|' || b)[1:16] AS digest FROM s"""
ORACLE_SQL["early_stopping"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, i, v AS best, event_id AS held, 0 AS bad, CAST(NULL AS BIGINT) AS stop FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, CASE WHEN gain THEN v ELSE best END, CASE WHEN gain THEN event_id ELSE held END, CASE WHEN gain THEN 0 ELSE bad + 1 END, CASE WHEN NOT gain AND bad + 1 >= 5 THEN event_id END
  FROM (SELECT w.user_id, e.i, e.v, e.event_id, w.best, w.held, w.bad, e.v < w.best - 1e-4 AS gain FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 WHERE w.stop IS NULL))
SELECT user_id, arg_max(held, i) AS best_epoch, arg_max(best, i) AS best, max(stop) AS stop_epoch FROM w GROUP BY user_id"""


def _utm_sql() -> str:
    """Krueger's series in SQL, with this package's constants; sinh and the like by exponentials."""
    sinh, cosh, atanh = (lambda x: f"((exp({x}) - exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) + exp(-({x}))) / 2)"), (lambda x: f"(ln((1 + {x}) / (1 - ({x}))) / 2)")
    e = repr(projection._E)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, a in enumerate(projection._ALPHA, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, a in enumerate(projection._ALPHA, 1))])
    scale = repr(projection.SCALE * projection._RADIUS)
    return f"""WITH {FIXES}, z AS (SELECT *, least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS zone, sin(radians(lat)) AS s FROM fixes),
q AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, {atanh('s')} - {e} * {atanh(f'({e} * s)')} AS psi FROM z),
t AS (SELECT *, {sinh('psi')} AS t FROM q), k AS (SELECT *, atan2(t, cos(dl)) AS xi, {atanh('(sin(dl) / sqrt(1 + t * t))')} AS eta FROM t)
SELECT event_id, CAST(zone AS BIGINT) AS zone, CAST(floor((500000.0 + {scale} * ({east})) / 30) AS BIGINT) AS px_col, CAST(floor((10000000.0 - (CASE WHEN lat < 0 THEN 10000000.0 ELSE 0 END + {scale} * ({north}))) / 30) AS BIGINT) AS px_row FROM k"""


ORACLE_SQL["utm_pixels"] = _utm_sql()

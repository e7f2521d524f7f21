"""The nearest fix on days before, against brute force."""

import math
import random

import pytest

from trackloom.operators import memory

ORIGIN = "event_id long, study_id string, individual_id string, t_last long, lat0 double, lon0 double"
FIX = "study_id string, individual_id string, t long, lat double, lon double"


def brute(origins, fixes, offsets, tolerance):
    out = set()
    for e, study, animal, last, *_ in origins:
        for n, s in enumerate(offsets):
            near = [(abs(t - last - s), t, lat, lon) for fs, fa, t, lat, lon in fixes if None not in (fs, fa, t, last) and (fs, fa) == (study, animal) and abs(t - last - s) <= tolerance and t <= last and s <= 0]
            out.add((e, n, *(min(near)[1:] if near else (None,) * 3)))
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_nearest_before(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    r = random.Random(5)
    fixes = [("s", f"a{r.randrange(3)}", 1_000_000 + r.randrange(4000), 40.0 + k, -97.0) for k in range(400)]
    fixes += [("s", "a0", None, 1.0, 1.0), (None, "a0", 1_001_000, 1.0, 1.0), ("s", None, 1_001_000, 1.0, 1.0), ("t", "a0", 1_001_000, 1.0, 1.0), ("s", "far", -5, 1.0, 1.0)]
    fixes += [("s", "a1", 1_002_000, 9.0, -97.0), ("s", "a1", 1_002_000, 8.0, -97.0), ("s", "a1", 1_002_020, 7.0, -97.0)]  # at one time; as far on either side of 1,002,010
    origins = [(k, *f[:3], 0.0, 0.0) for k, f in enumerate(fixes)] + [(-1, "s", "a1", 1_002_110, 0.0, 0.0), (-2, "s", "none", 1_002_110, 0.0, 0.0)]
    offsets = [-100.0, -37.5, 0.0, 50.0, -900.0]
    got = memory.nearest_before(spark.createDataFrame(origins, ORIGIN), spark.createDataFrame(fixes, FIX), offsets, 20.0).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(origins) * len(offsets)
    assert {(x["event_id"], x["n"], x["fix_t"], x["fix_lat"], x["fix_lon"]) for x in got} == brute(origins, fixes, offsets, 20.0)


def test_memory_steps_send_no_table_to_the_driver(spark):
    fixes = spark.createDataFrame([("s", "a", 3600 * k, 40.0 + k / 1e4, -97.0) for k in range(100)], FIX)
    x = memory.memory_steps(fixes.selectExpr("t as event_id", "study_id", "individual_id", "t as t_last", "lat as lat0", "lon as lon0"), fixes, 2, 3600, 2)
    got = {(r["event_id"], r["k"]): r for r in x.collect()}
    assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    r = got[3600 * 60, 1]  # one hour on, and one or two days before: 23 and 47 hours
    assert len(got) == 200 and r["d1_avail"] == 1 and r["frac"] == 1.0 and r["d1_dx"] == 0
    assert r["d1_dy"] == pytest.approx(-23e-4 * 6371008.8 * math.pi / 180) and r["mean_dy"] == pytest.approx(-35e-4 * 6371008.8 * math.pi / 180)
    assert got[0, 1]["frac"] == 0.0 and got[0, 1]["d1_avail"] == 0

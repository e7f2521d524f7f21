"""Fixes of an animal in one second: memory_step takes the one that its SQL takes."""

import duckdb
import pytest

from tests.test_queries import rows
from trackloom.plans import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("values", [(1.0, 2.0, 3.0), (3.0, 2.0, 1.0), (2.0, 3.0, 1.0)])
def test_of_fixes_in_one_second_the_last_counts(spark, tmp_path, values):
    duck = duckdb.connect()
    duck.sql("SET timezone = 'UTC'")
    duck.sql(f"""CREATE TABLE events AS SELECT row_number() OVER (ORDER BY step, user_id, i) AS event_id, TIMESTAMP '2024-01-01 06:00:00' + to_microseconds(step * 21600000000 + (3 - i) * 1000) AS ts,
        user_id, 'view' AS event_type, CAST({list(values)}[i] * 100 + step AS DOUBLE) AS value, '{{"k": ' || (step * 3 + i) || '}}' AS props
        FROM range(9) a(step), range(4) b(user_id), range(1, 4) c(i) ORDER BY event_id""")
    events = spark.createDataFrame([tuple(r) for r in duck.sql("SELECT * FROM events ORDER BY event_id DESC").fetchall()], EVENTS)
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["memory_step"](spark, str(tmp_path)).toPandas()
    assert got["d1_avail"].sum() > 0 and rows(got) == rows(duck.sql(registry.ORACLE_SQL["memory_step"]).df())

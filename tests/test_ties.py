"""Values on a border and ties, against the SQL."""

import datetime

import duckdb

from wakeline.plans import report_queries, track_queries


def write_events(spark, at, data):
    """events of (user, seconds, speed), with their SQL view."""
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(seconds=s), user, "view", v, "{}") for i, (user, s, v) in enumerate(data)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    return duck


def test_a_speed_on_the_border_of_the_band(spark, tmp_path):
    low, high = 59.05, 60.05
    assert (1 - 0.95) * low + 0.95 * high < 60  # in doubles; exactly 60
    duck = write_events(spark, tmp_path, [(2, 0, low), (2, 43_200, high), (4, 0, 10.0), (4, 43_200, 60.0)])
    got = report_queries.fast_straight(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == duck.sql(report_queries.ORACLE["fast_straight"]).fetchall() == [(2, 1, 86_400.0)]


def test_the_first_of_two_closest_points_counts(spark, tmp_path):
    """The SQL leaves this tie open; one thread takes the first in time, as the query."""
    data = [(1, 1000.0 * (i % 700), float(i)) for i in range(1001)]
    duck = write_events(spark, tmp_path, [(1, s + i // 700, v) for i, (_, s, v) in enumerate(data)])
    duck.sql("SET threads = 1")
    names = ["mmsi", "port_region", "n_points", "cpa_range_nm", "t_cpa", "points_before_cpa"]
    got = sorted(tuple(r) for r in track_queries.closest_point(spark, str(tmp_path)).select(names).collect())
    assert len(got) and got == sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({track_queries.ORACLE['closest_point']})").fetchall())

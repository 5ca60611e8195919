"""Runs that read what earlier ones wrote, funding files of mixed layouts, smoothing, and streams with late rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.snapshots import adaptive_lambda, edge_summary, latest_snapshot, merge_edges, monthly_membership, stored, write_incomplete, write_snapshot
from tidemark.plans.discovery import ema
from tidemark.plans.episodes import feature_frame
from tidemark.sources.readers import read_funding
from tidemark.streaming.streams import event_stream, stream_bars, stream_cooldown

UNITS = "verb string, unit string, n double, mean double, var double"


def test_smoothing_stays_within_the_cap(spark):
    units = spark.createDataFrame([("v", "A", 500.0, 0.2, 0.1), ("v", "B", 500.0, -0.2, 0.1)], UNITS)
    previous = spark.createDataFrame([("v", 1000.0), ("w", 3.0)], "verb string, lambda double")
    r = adaptive_lambda(units, ["verb"], previous, alpha=1.0, cap=0.5).first()
    assert (r.status, r.prev, r["lambda"], r.raw) == ("adaptive_smoothed", 1000.0, 500.0, 5.0)
    gentle = adaptive_lambda(units, ["verb"], previous, alpha=0.1).first()
    assert gentle["lambda"] == pytest.approx(0.9 * 1000 + 0.1 * 5)


def test_every_status(spark):
    rows = [("few", "a", 50.0, 1.0, 1.0), ("few", "b", 60.0, 2.0, 1.0), ("one", "a", 900.0, 1.0, 4.0), ("one", "b", 0.0, 9.0, 9.0), ("two", "a", 300.0, 1.0, 2.0), ("two", "b", 100.0, 3.0, 6.0), (None, "a", None, None, None)]
    previous = spark.createDataFrame([("few", 7.0), ("one", 7.0), ("two", -1.0)], "verb string, lambda double")
    got = {r.verb: r for r in adaptive_lambda(spark.createDataFrame(rows, UNITS), ["verb"], previous).collect()}
    assert (got["few"].status, got["few"]["lambda"], got["few"].sigma_within) == ("insufficient_data", 0.0, None)
    assert (got["one"].status, got["one"]["lambda"], got["one"].sigma_within, got["one"].children) == ("single_child", 5000.0, 4.0, 1)
    within, between = (299 * 2 + 99 * 6) / 398, (300 * 0.25 + 100 * 2.25) / 400
    assert got["two"].status == "adaptive" and got["two"].prev is None and got["two"].sigma_between == pytest.approx(between) and got["two"].raw == 5.0 and got["two"].sigma_within == pytest.approx(within)
    assert got[None].status == "insufficient_data" and adaptive_lambda(spark.createDataFrame([], UNITS), ["verb"]).count() == 0


def test_two_runs_through_files(spark, tmp_path):
    path = str(tmp_path / "lambdas")
    first = spark.createDataFrame([("v", "A", 500.0, 0.02, 0.1), ("v", "B", 500.0, -0.02, 0.1)], UNITS)
    second = spark.createDataFrame([("v", "A", 500.0, 0.2, 0.1), ("v", "B", 500.0, -0.2, 0.1), ("new", "A", 500.0, 0.1, 0.1), ("new", "B", 500.0, -0.1, 0.1)], UNITS)
    assert stored(spark, path) is None and latest_snapshot(spark, path, "event", 9) is None
    write_snapshot(adaptive_lambda(first, ["verb"]), path, "event", 1)
    write_snapshot(adaptive_lambda(second, ["verb"], latest_snapshot(spark, path, "event", 2)), path, "event", 2)
    write_snapshot(adaptive_lambda(second, ["verb"], latest_snapshot(spark, path, "event", 2)), path, "event", 2)  # again
    got = {(r.run, r.verb): r for r in stored(spark, path).collect()}
    assert len(got) == 3 and got[1, "v"]["lambda"] == pytest.approx(250.0, rel=1e-9) and got[2, "v"].prev == got[1, "v"]["lambda"]
    assert got[2, "v"].status == "adaptive_smoothed" and got[2, "v"]["lambda"] == pytest.approx(0.9 * got[1, "v"]["lambda"] + 0.1 * 5) and got[2, "new"].status == "adaptive"
    assert latest_snapshot(spark, path, "event", 2).count() == 1 and latest_snapshot(spark, path, "state", 2) is None


def test_second_write_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(s, dt.date(2024, 1, d), d * 100 + i) for s in "ab" for d in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, day date, ts long")
    assert write_incomplete(df, path, ["symbol", "day"]).count() == 6
    before = sorted(stored(spark, path).inputFiles())
    assert write_incomplete(df, path, ["symbol", "day"]).count() == 0 and sorted(stored(spark, path).inputFiles()) == before
    more = df.unionByName(spark.createDataFrame([("a", dt.date(2024, 1, 2), 999), ("c", dt.date(2024, 1, 1), 1)], df.schema))
    told = {(r.symbol, r.day.day): (r.expected, r.found) for r in write_incomplete(more, path, ["symbol", "day"]).collect()}
    assert told == {("a", 2): (5, 4), ("c", 1): (1, 0)} and stored(spark, path).count() == 26
    assert len(set(stored(spark, path).inputFiles()) & set(before)) == len(before) - sum("symbol=a/day=2024-01-02" in f for f in before)


def test_funding_layouts_in_one_folder(spark, tmp_path):
    T = 1_704_096_000  # 2024-01-01 08:00
    files = {
        "a": f"calc_time,funding_interval_hours,last_funding_rate\n{T * 1000 + 5},8,0.0001\nbad,8,0.5\n{(T + 28800) * 1000},8,\n",
        "b": f"Funding Rate,fundingTime\n0.0002,{T + 14399}\n",
        "c": f"{(T - 14400) * 1000},8,0.0003\n{(T + 14400) * 1000},8,-0.0004\n",
        "d": f"{T},0.0005\n",
        "e": "symbol,fundingRate,time\nX,0.0006,1704096000000\n",
    }
    for name, text in files.items():
        (tmp_path / f"s={name}").mkdir()
        (tmp_path / f"s={name}" / "x.csv").write_text(text)
    got = sorted((r.symbol, r.ts.hour, r.funding_rate) for r in read_funding(spark, str(tmp_path), F.regexp_extract(F.col("_metadata.file_path"), "s=(.)", 1)).collect())
    assert got == [("a", 8, 0.0001), ("b", 8, 0.0002), ("c", 8, 0.0003), ("c", 16, -0.0004), ("d", 8, 0.0005), ("e", 8, 0.0006)]


def test_edges_over_three_runs(spark):
    schema = "edge_id string, run long, cand long, effect double, promoted boolean"
    runs = [[("x", 1, 1, 1.0, True), ("y", 1, 1, None, False)], [("x", 2, 1, 3.0, False), ("x", 2, 2, float("nan"), True)], [("x", 2, 1, 4.0, True), ("x", 3, 5, 2.0, False), ("y", 3, 1, 7.0, True)]]
    table = None
    for rows in runs:
        table = merge_edges(table, spark.createDataFrame(rows, schema))
    got = {r.edge_id: r for r in edge_summary(table).collect()}
    x = got["x"]
    assert (x.first_run, x.last_run, x.cand, x.tested, x.promoted, x.median_effect) == (1, 3, 5, 4, 3, 2.0)
    assert x.decay == pytest.approx(np.polyfit([0, 1, 2], [1, 4, 2], 1)[0]) and (got["y"].decay, got["y"].median_effect, got["y"].tested) == (0.0, 7.0, 2)


def test_membership_by_month(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 31)), ("a", dt.date(2024, 3, 1)), ("b", dt.date(2024, 2, 10))], "k string, d date")
    listed, members = monthly_membership(df, "k", "d", "d", 7)
    assert {(r.k, r.active) for r in listed.collect()} == {("a", True), ("b", False)}
    assert sorted((r.month.month, r.k) for r in members.collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "a")]


@pytest.mark.parametrize("alpha", [0.002, 0.04, 0.5, 0.6, 0.9, 0.999, 1.0])
def test_ema_equals_the_loop(spark, alpha):
    x = np.random.default_rng(3).normal(size=5000) * np.r_[np.full(2500, 1e6), np.ones(2500)]
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "k": np.arange(1, 5001), "x": x})).repartition(4)
    want, s = [], x[0]
    for i, v in enumerate(x):
        s = v if i == 0 else alpha * v + (1 - alpha) * s
        want.append(s)
    got = [r.ema for r in ema(df, "s", "k", "x", alpha).orderBy("k").collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)
    with pytest.raises(ValueError, match="alpha"):
        ema(df, "s", "k", "x", 1.5)


def test_last_event_of_a_time_names_the_features(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("ERROR", "S1", "1", at, {"k": 9.0}), ("SIGNUP", "S1", "2", at, {"k": 1.0, "j": 5.0}), ("ERROR", "S2", "3", at, {"k": 4.0}), ("ERROR", "S2", "4", at, {"k": 3.0})]
    df = spark.createDataFrame(rows, "event_type string, symbol string, event_id string, enter_ts timestamp_ntz, features map<string,double>")
    got = {r.symbol: (r.error_k, r.signup_k, r.signup_j) for r in feature_frame(df).collect()}
    assert got == {"S1": (None, 1.0, 5.0), "S2": (3.0, None, None)}
    with pytest.raises(ValueError, match="feature names"):
        feature_frame(df, most=2)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def drain(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), q


def test_streams_read_files_and_folders(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=7 * i), i, "abc"[i % 3], float(i), "{}") for i in range(200)], EVENTS)
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    df.repartition(3).write.parquet(str(tmp_path / "lake" / "events.parquet"))
    one, _ = drain(spark, stream_bars(event_stream(spark, str(tmp_path))), tmp_path / "one")
    many, _ = drain(spark, stream_bars(event_stream(spark, str(tmp_path / "lake"))), tmp_path / "many")
    assert one.count() == many.count() > 50 and one.exceptAll(many).count() == 0


def test_cooldown_forgets_and_drops_late_rows(spark, tmp_path):
    t0, folder = dt.datetime(2024, 1, 1), str(tmp_path / "in" / "events.parquet")
    hour = lambda h: t0 + dt.timedelta(hours=h)
    path = tmp_path / "run"
    kept = []
    batches = [[(1, 0, "a"), (2, 3, "a"), (3, 6, "a"), (4, 1, "b")], [(5, 20, "b"), (6, 13, "a")], [(7, 2, "a"), (8, 40, "c")], [(9, 41, "a"), (10, 44, "a")]]
    for rows in batches:
        spark.createDataFrame([(i, hour(h), 0, k, 0.0, "{}") for i, h, k in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        out, query = drain(spark, stream_cooldown(event_stream(spark, str(tmp_path / "in")), "event_type", pd.Timedelta(hours=6)), path)
        kept = sorted(r.event_id for r in out.collect())
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept == [1, 3, 4, 5, 6, 8, 9]  # 2 and 10 are within six hours, 7 is behind the watermark
    assert states[-1] < 3  # silent keys are gone

import datetime as dt
import random

import pytest

from stowage.operators import forecasting, snapshots

DAY0 = dt.date(2026, 5, 1)
DDL = "volume_id string, snapshot_date date, used_size_bytes bigint"


def _series(frame, **series):
    rows = [(name, DAY0 + dt.timedelta(days=d), b) for name, points in series.items()
            for d, b in points]
    return frame(rows, DDL)


def _run(frame, capacity=500 * 10**9, **series):
    points = forecasting.series_points(_series(frame, **series))
    caps = frame([(name, capacity) for name in series], "series string, capacity_bytes bigint")
    rows = forecasting.forecasts(points, "2026-06-01", caps).collect()
    return {r["series"]: r for r in rows}


def _loop(points, alpha=0.3):
    """Smoothed and averaged growth by plain loops, to check the closed forms."""
    deltas = [(b1 - b0) / (d1 - d0) for (d0, b0), (d1, b1) in zip(points, points[1:])]
    level = deltas[0]
    for delta in deltas[1:]:
        level = alpha * delta + (1 - alpha) * level
    return level, sum(deltas[-7:]) / len(deltas[-7:])


LINEAR = [(d, 100 * 10**9 + d * 10**9) for d in range(30)]
FLAT = [(d, 10**11) for d in range(30)]
_rng = random.Random(42)
NOISY = [(d, 10**11 + _rng.randint(-5 * 10**9, 5 * 10**9)) for d in range(30)]
GAPS = [(d, 10**11 + d * d * 10**7) for d in (0, 1, 5, 6, 20, 21, 22, 40)]
FALLING = [(d, 10**11 - d * 10**8) for d in range(10)]


def test_line(frame):
    row = _run(frame, a=LINEAR)["a"]["auto"]
    assert row["model_type"] == "linear_regression"
    assert row["daily_growth_bytes"] == pytest.approx(10**9)
    assert row["r_squared"] == pytest.approx(1.0)
    assert row["predicted_total_30d"] == pytest.approx(159 * 10**9, rel=1e-9)
    assert row["days_until_full"] == (500 - 129)
    assert row["exhaustion_date"] == dt.date(2026, 6, 1) + dt.timedelta(days=371)
    assert row["confidence"] == 0.95 and row["trend"] == "critical_growth"


def test_flat_has_no_fit_and_no_end(frame):
    row = _run(frame, a=FLAT)["a"]["auto"]
    assert row["r_squared"] == 0.0 and row["days_until_full"] is None
    assert row["trend"] == "stable" and row["predicted_total_90d"] == 10**11


@pytest.mark.parametrize("points", [NOISY, GAPS, FALLING])
def test_closed_forms_equal_loops(frame, points):
    row = _run(frame, a=points)["a"]
    smoothed, mean = _loop(points)
    assert row["smoothing"]["daily_growth_bytes"] == pytest.approx(max(0, smoothed), rel=1e-9)
    assert row["moving"]["daily_growth_bytes"] == pytest.approx(max(0, mean), rel=1e-9)


def test_selection(frame):
    got = _run(frame, n1=LINEAR[:1], n2=LINEAR[:2], n3=LINEAR[:3], n4=LINEAR[:4], n5=LINEAR[:5],
               noisy=NOISY)
    chosen = {name: row["auto"]["model_type"] for name, row in got.items()}
    assert chosen == {"n1": "auto", "n2": "auto", "n3": "moving_average", "n4": "moving_average",
                      "n5": "linear_regression", "noisy": "exponential_smoothing"}
    assert got["n1"]["linear"]["daily_growth_bytes"] == 0.0
    assert got["n2"]["linear"]["daily_growth_bytes"] == pytest.approx(10**9)
    assert got["n2"]["auto"]["data_points_used"] == 2


def test_falling_series_predicts_no_less_than_now(frame):
    row = _run(frame, a=FALLING)["a"]["linear"]
    assert row["daily_growth_bytes"] == 0.0
    assert row["predicted_total_30d"] == FALLING[-1][1] and row["days_until_full"] is None


def test_full_disk_has_no_date(frame):
    assert _run(frame, capacity=10**9, a=LINEAR)["a"]["auto"]["days_until_full"] is None


def test_far_end_is_limited(frame):
    slow = [(d, 10**11 + d) for d in range(10)]
    row = _run(frame, a=slow)["a"]["auto"]
    assert row["days_until_full"] == 99999


def test_default_capacity(frame):
    points = forecasting.series_points(_series(frame, a=LINEAR))
    row = forecasting.forecasts(points, "2026-06-01").first()
    assert row["capacity_bytes"] == 2 * LINEAR[-1][1]


def test_large_values_stay_exact(frame):
    base = 9 * 10**16
    row = _run(frame, capacity=9 * 10**18, a=[(d, base + d * 10**13) for d in range(400)])["a"]
    assert row["linear"]["daily_growth_bytes"] == pytest.approx(10**13, rel=1e-12)


def test_growth_rate(frame):
    series = _series(frame, a=LINEAR, one=LINEAR[:1])
    rates = {r["volume_id"]: r["daily_growth_bytes"] for r in
             snapshots.growth_rate(series).collect()}
    assert rates == {"a": pytest.approx(10**9), "one": 0.0}


def test_last_points_and_history(frame):
    rows = frame([("a", DAY0 + dt.timedelta(days=i), 1, i, 1, 1) for i in range(10)],
                 "volume_id string, snapshot_date date, total_size_bytes bigint, "
                 "used_size_bytes bigint, file_count bigint, dir_count bigint")
    assert sorted(r["used_size_bytes"] for r in snapshots.growth_series(rows, 3).collect()) == [7, 8, 9]
    got = snapshots.snapshot_history(rows, "2026-05-03", "2026-05-05").collect()
    assert [r["used_size_bytes"] for r in got] == [4, 3, 2]
    assert snapshots.latest_snapshot(rows).first()["used_size_bytes"] == 9


def test_changes_over_days_of_the_calendar(frame):
    days = [0, 1, 2, 7, 28, 30, 37]
    ddl = "volume_id string, snapshot_date date, used_size_bytes bigint, scan_id string"
    rows = [("a", DAY0 + dt.timedelta(days=d), d * d, "s") for d in days]
    rows += [("a", DAY0 + dt.timedelta(days=7), 5, "r"), ("a", DAY0 + dt.timedelta(days=7), 77, "t")]
    value = {d: d * d for d in days} | {7: 77}
    got = {(r["snapshot_date"] - DAY0).days: r for r in snapshots.usage_changes(frame(rows, ddl)).collect()}
    assert sorted(got) == days
    for day, row in got.items():
        for name, n in (("daily", 1), ("weekly", 7), ("monthly", 30)):
            base = max((d for d in days if n <= day - d < 2 * n), default=None)
            want = None if base is None else value[day] - value[base]
            assert row[f"{name}_growth_bytes"] == want
            assert row[f"{name}_base_date"] == (None if base is None else DAY0 + dt.timedelta(days=base))
    assert got[28]["daily_growth_bytes"] is None and got[28]["weekly_growth_bytes"] is None
    assert snapshots.latest_snapshot(frame([*rows, ("a", DAY0 + dt.timedelta(days=37), 9, "z"),
                                            ("a", DAY0 + dt.timedelta(days=37), 8, "y")], ddl)).first()["scan_id"] == "z"


def test_later_snapshot_replaces(frame):
    ddl = "volume_id string, snapshot_date date, used_size_bytes bigint, created_at timestamp"
    t = dt.datetime(2026, 5, 1, 8)
    stored = frame([("a", DAY0, 1, t)], ddl)
    arrived = frame([("a", DAY0, 2, t + dt.timedelta(hours=1)), ("b", DAY0, 3, t)], ddl)
    got = {r["volume_id"]: r["used_size_bytes"] for r in
           snapshots.upsert_snapshots(stored, arrived).collect()}
    assert got == {"a": 2, "b": 3}

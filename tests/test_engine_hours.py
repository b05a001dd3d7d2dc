import random
from datetime import datetime, timedelta, timezone

import pytest

from tankline import operators as ops
from tankline.schema import ENGINE_HOURS, IDLE_INTERVALS

from .conftest import ms

T0 = ms("2024-01-01 00:00:00") // 1000
T1 = T0 + 5 * 86_400


def entries_of(spark, rows):
    return spark.createDataFrame([((T0 + s) * 1000 + 250, e, v) for e, s, v in rows], ENGINE_HOURS)


def asked(spark, machines, t0=T0, t1=T1):
    return spark.createDataFrame([(e, t0, t1) for e in machines], "eqmt int, t0 int, t1 int")


def idle_of(spark, rows):
    day = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(e, s, day + timedelta(seconds=a), day + timedelta(seconds=b)) for e, s, a, b in rows]
    return spark.createDataFrame(data, IDLE_INTERVALS)


def test_by_meter_and_by_clock(spark):
    entries = entries_of(
        spark,
        [(1, 3_600, 100), (1, 7_200, 102), (1, 36_000, 108), (1, 40_000, 300), (1, 90_000, 120),
         (2, 3_600, 50), (2, 7_200, 0)],
    )
    got = {r.eqmt: (r.kept, r.engine_hours) for r in ops.engine_hours(entries, asked(spark, (1, 2, 3))).collect()}
    # Kept: 102 (gain 2 in an hour) and 108; 300 jumps, 120 falls, 100 has none before.
    assert got[1] == (2, round(6 + (432_000 - 36_000) / 3600 + 7_200 / 3600, 1))
    assert got[2] == (0, 120.0) and got[3] == (0, 120.0)
    literal = ops.engine_hours(entries, asked(spark, (1,)), literal=True).first()
    assert literal.engine_hours == 120.0


def test_idle_time_is_taken_off(spark):
    idle = idle_of(
        spark,
        [(1, 1, -3_600, 1_800), (1, 3, 80_000, 100_000), (1, 2, 0, 400_000), (1, 1, 431_000, 900_000),
         (2, 1, 500_000, 600_000)],
    )
    got = {r.eqmt: r.idle_seconds for r in ops.idle_seconds(asked(spark, (1, 2)), idle).collect()}
    assert got == {1: 1_800 + 20_000 + 1_000, 2: 0.0}
    hours = ops.engine_hours(entries_of(spark, []), asked(spark, (1, 2)), idle).collect()
    assert {r.eqmt: r.engine_hours for r in hours} == {1: (432_000 - 22_800) / 3600, 2: 120.0}
    entries = entries_of(spark, [(1, 1_000, 10), (1, 3_600, 11), (1, 90_000, 20)])
    row = ops.engine_hours(entries, asked(spark, (1,)), idle).first()
    tail = (432_000 - 90_000 - 10_000 - 1_000) / 3600
    head = (3_600 - 1_800) / 3600
    assert row.engine_hours == pytest.approx(round(9 + tail + head, 1))


def loop(entries):
    """Number kept, gain, first and last time, over a machine's own sequence."""
    inside = sorted((t, v) for t, v in entries if v > 0 and 0 <= t <= 5 * 86_400)
    kept = [
        (t, v) for (p, w), (t, v) in zip(inside, inside[1:]) if v > w and v - w <= (t - p) / 3600 + 1
    ]
    if len(kept) < 2:
        return len(kept), 120.0
    gain = max(v for _, v in kept) - min(v for _, v in kept)
    return len(kept), gain + (432_000 - kept[-1][0]) / 3600 + kept[0][0] / 3600


@pytest.mark.parametrize("setting", [{}, {"slot_ms": 3_600_000}, {"slot_ms": 86_400_000, "prune": False}], ids=str)
def test_against_a_loop(spark, setting):
    machines = {}
    for e in range(120):
        rng = random.Random(e)
        t, v, seq = 0, 100, []
        for _ in range(rng.randint(0, 25)):
            t += rng.choice([0, 600, 3_600, 3_600, 20_000, 90_000])
            v += rng.choice([0, 1, 1, 2, 3, 30, -20])
            seq += [(t, v)] * rng.choice([1, 1, 2])
        machines[e] = seq
    entries = entries_of(spark, [(e, t, v) for e, seq in machines.items() for t, v in seq])
    for r in ops.engine_hours(entries, asked(spark, machines), **setting).collect():
        kept, hours = loop(machines[r.eqmt])
        assert r.kept == kept
        assert r.engine_hours == pytest.approx(hours, abs=0.0501)

"""Operators on raw readings, against plain loops over one machine's sequence."""

import random

import pytest
from pyspark.sql import functions as F

from tankline import operators as ops

from .conftest import ms, readings_of, windows_of

START = "2024-01-01 00:00:00"
WINDOW = (START, "2024-01-01 06:00:00")
HOUR = 3_600_000


def machine(seed):
    """A random sequence of (ms, level): NULLs, ties, copies, plateaus, refuels."""
    rng = random.Random(seed)
    t, x, out = ms(START), rng.choice([0, 50, 300, None]), []
    for _ in range(rng.randint(0, 40)):
        t += rng.choice([0, 0, 1, 60_000, 600_000, 900_000])
        kind = rng.random()
        if kind < 0.12:
            out.append((t, None))
            continue
        base = x if x is not None else 100
        if kind < 0.4:
            x = base + rng.choice([1, 39.9, 40, 40.1, 60, 99.9, 100, 100.1, 300])
        elif kind < 0.85:
            x = max(0, base - rng.choice([0.1, 5, 30, 100, 100.1, 250]))
        x = None if x is None else round(x, 1)
        out.extend([(t, x)] * rng.choice([1, 1, 1, 2, 5]))
    return out


def in_order(sequence, closed):
    lo, hi = ms(WINDOW[0]), ms(WINDOW[1])
    kept = [r for r in sequence if lo <= r[0] and (r[0] <= hi if closed == "both" else r[0] < hi)]
    return [x for _, x in sorted(kept, key=lambda r: (r[0], r[1] is not None, r[1] or 0))]


def less(a, b):
    return a is not None and b is not None and round(a - b, 8) < 0


def loop_raw_drops(levels):
    known = [x for x in levels if x is not None]
    return sum(max(a - b, 0) for a, b in zip(known, known[1:]))


def loop_analysis(levels):
    used, refilled, refills, anomalies = 0.0, 0.0, 0, 0
    if not levels:
        return (0.0, 0.0, 0, 0, None, None, 0)
    opened = last = levels[0]
    for x in levels[1:]:
        if x is not None and last is not None:
            change = round(x - last, 8)
            if change > 40:
                used = None if used is None or opened is None else used + opened - last
                refilled, refills, opened = refilled + change, refills + 1, x
            elif change < -100:
                anomalies += 1
        last = x
    if less(last, opened) and used is not None:
        used += opened - last
    return (used, refilled, refills, anomalies, levels[0], last, len(levels))


def loop_confirmed(levels, threshold=100):
    if not levels:
        return 0.0
    mode, total, climb = "consume", 0.0, 0.0
    first = low = last = levels[0]
    for x in levels[1:]:
        up, down = less(last, x), less(x, last)
        if mode == "consume":
            if less(x, low):
                low = x
            elif up:
                mode, climb = "maybe", x - last
        elif mode == "maybe":
            if up:
                climb += x - last
                if round(climb, 8) >= threshold:
                    total += first - low if less(low, first) else 0
                    mode = "climb"
            elif down:
                mode, low = "consume", x if low is None else min(low, x)
        elif down:
            mode, first, low = "consume", last, x
        last = x
    if mode != "climb" and less(low, first):
        total += first - low
    return total


MACHINES = {e: machine(e) for e in range(400)}
# Slots of an hour, of ten minutes, and of a day.
SETTINGS = [{}, {"slot_ms": 600_000, "prune": False}, {"slot_ms": 86_400_000}]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(e, t, x) for e, seq in MACHINES.items() for t, x in seq]
    readings = readings_of(spark, rows).repartition(8).cache()
    return readings, windows_of(spark, [(e, *WINDOW) for e in MACHINES])


@pytest.mark.parametrize("setting", SETTINGS, ids=str)
def test_raw_drops(data, setting):
    got = {r.eqmt: r.fuel_used for r in ops.fuel_used_raw_drops(*data, **setting).collect()}
    want = {e: loop_raw_drops(in_order(seq, "both")) for e, seq in MACHINES.items()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("setting", SETTINGS, ids=str)
def test_analysis(data, setting):
    for r in ops.analyze_fuel(*data, **setting).collect():
        got = (
            r.total_consumption_liters, r.total_refilled_liters, r.refills_count,
            r.anomalous_drops_count, r.start_fuel_level, r.end_fuel_level, r.data_points_processed,
        )
        want = loop_analysis(in_order(MACHINES[r.eqmt], "left"))
        assert got == pytest.approx(want, abs=1e-6), r.eqmt
        hours = want[0] / 6 if want[0] and want[0] > 0 else 0
        assert r.avg_consumption_lph == pytest.approx(hours, abs=1e-6)


@pytest.mark.parametrize("setting", SETTINGS, ids=str)
def test_confirmed_refills(data, setting):
    rows = ops.fuel_between_confirmed_refills(*data, **setting).collect()
    got = {r.eqmt: r.consumption for r in rows}
    want = {e: loop_confirmed(in_order(seq, "left")) for e, seq in MACHINES.items()}
    assert got == pytest.approx(want, abs=1e-6)
    assert len({round(v) for v in want.values()}) > 50


def test_level_difference(data):
    readings, windows = data
    for r in ops.fuel_level_difference(readings, windows).collect():
        def level(at):
            past = [x for x in MACHINES[r.eqmt] if x[0] <= at]
            return max(past, key=lambda p: (p[0], p[1] is not None, p[1] or 0))[1] if past else None

        a, b = level(r.from_ms), level(r.to_ms)
        unknown = a is None or b is None
        assert r.status == ("no_level" if unknown else "ok")
        assert r.consumption == (None if unknown else pytest.approx(a - b))


def sequence(spark, levels):
    t = ms("2024-01-01 00:30:00")
    rows = [(1, t + i * 1_500_000, x) for i, x in enumerate(levels)]
    return readings_of(spark, rows), windows_of(spark, [(1, *WINDOW)])


@pytest.mark.parametrize(
    "levels,expected",
    [
        ((500, 480, 470, 560, 550, 520), 30),  # one rise is never confirmed
        ((500, 470, 530, 600, 580, 520), 110),
        ((500, 470, 900, 890), 30),
        ((500, 400, 450, 500, 550, 600), 100),  # ends on the climb
        ((500,), 0),
    ],
)
def test_confirmed_refills_worked(spark, levels, expected):
    got = ops.fuel_between_confirmed_refills(*sequence(spark, levels)).first()
    assert got.consumption == expected


def test_analysis_worked(spark):
    r = ops.analyze_fuel(*sequence(spark, (100, 90, 85, 140, 130, 25))).first()
    assert (r.total_consumption_liters, r.total_refilled_liters) == (130.0, 55.0)
    assert (r.refills_count, r.anomalous_drops_count, r.data_points_processed) == (1, 1, 6)


def test_as_of_looks_back_without_limit(spark):
    readings = readings_of(
        spark, [(1, "2019-05-05 05:05:05", 80), (1, "2024-01-01 00:00:00.001", 60), (2, WINDOW[1], 5)]
    )
    windows = windows_of(spark, [(1, *WINDOW), (2, *WINDOW)])
    got = {r.eqmt: (r.consumption, r.status) for r in ops.fuel_level_difference(readings, windows).collect()}
    assert got == {1: (20.0, "ok"), 2: (None, "no_level")}


def crowded(spark, minutes=2_000):
    """One machine with three copies of a reading every minute, falling by one every other minute."""
    t = ms("2024-01-01 00:00:00")
    seq = [(t + i * 60_000, float(5000 - i // 2)) for i in range(minutes) for _ in range(3)]
    return seq, readings_of(spark, [(1, *r) for r in seq] + [(2, t + 5, 9.0), (2, t + 9, 4.0)])


def test_overlapping_requests_share_running_totals(spark):
    """Fifty requests on one crowded machine meet no rows: each puts two marks among them."""
    from tankline.operators.spans import spans_of
    from tankline.operators.sweeps import end_marks

    seq, readings = crowded(spark)
    t = seq[0][0]
    day = "2024-01-0{} {:02}:{:02}:00"
    windows = windows_of(spark, [(1, day.format(1, 0, i), day.format(2, 6, i)) for i in range(50)])
    got = {(r.time_from.minute, r.fuel_used) for r in ops.fuel_used_raw_drops(readings, windows).collect()}
    inside = lambda i: [x for at, x in seq if t + i * 60_000 <= at <= t + (30 * 60 + i) * 60_000]
    assert got == {(i, inside(i)[0] - inside(i)[-1]) for i in range(50)}
    assert end_marks(spans_of(windows), "both").count() == 100
    plan = ops.fuel_used_raw_drops(readings, windows, prune=False)._jdf.queryExecution().executedPlan().toString()
    # The only joins bring the answers back to the requests.
    assert plan.count("Join") <= 2, plan


def test_year_long_requests_take_few_states(spark):
    """Fifty overlapping requests of a year each: under a hundred pieces, sharing all but the cut ones."""
    from datetime import datetime, timedelta

    from tankline.operators.folds import FAN, SIZES, pieces_of
    from tankline.operators.spans import spans_of
    from tankline.operators.sweeps import UNIT_MS

    start = datetime(2023, 1, 1)
    times = [start + timedelta(minutes=37 * i, seconds=i) for i in range(50)]
    windows = windows_of(spark, [(1, str(a), str(a + timedelta(days=365, hours=i))) for i, a in enumerate(times)])
    pieces = pieces_of(spans_of(windows), "left", UNIT_MS).collect()
    sizes = {UNIT_MS * FAN**k for k in range(SIZES + 1)}
    for r in spans_of(windows).collect():
        own = sorted((p.lo, p.hi, p.cut) for p in pieces if (p.from_ms, p.to_ms) == (r.from_ms, r.to_ms))
        assert len(own) < 100
        assert own[0][0] == r.from_ms and own[-1][1] == r.to_ms
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert all(cut or (hi - lo in sizes and lo % (hi - lo) == 0) for lo, hi, cut in own)
        assert sum(cut for *_, cut in own) <= 2
    # Ten days further, as blocks of the largest size are the same for all.
    assert len({(p.lo, p.hi) for p in pieces if not p.cut}) < 50 * 40


@pytest.mark.parametrize("length", [0, 1, 899_999, 900_000, 900_001, 14_400_000, 250_000_000])
@pytest.mark.parametrize("start", [0, 1, 900_000, 14_399_999, -5])
def test_pieces_cover_any_span_once(spark, start, length):
    from tankline.operators.folds import pieces_of
    from tankline.operators.sweeps import UNIT_MS

    spans = spark.createDataFrame([(1, start, start + length)], "eqmt int, from_ms long, to_ms long")
    for closed, end in (("left", start + length), ("both", start + length + 1)):
        pieces = sorted((p.lo, p.hi) for p in pieces_of(spans, closed, UNIT_MS).collect())
        assert sum(b - a for a, b in pieces) == end - start
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert not pieces or (pieces[0][0], pieces[-1][1]) == (start, end)


def test_states_compose_in_any_grouping(spark):
    """The state of a sequence does not depend on where it is cut, nor on the order of composing."""
    from tankline.operators.confirmed_refills import _combine, _consumed, _runs, _states
    from tankline.operators.slots import in_order, merged_copies

    rng = random.Random(5)
    sequences = {e: machine(e)[:14] for e in range(0, 300, 3)}
    rows, cuts = [], {}
    for e, seq in sequences.items():
        seq = sorted(set(seq), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        cuts[e] = sorted(rng.sample(range(len(seq) + 1), min(3, len(seq) + 1)))
        rows += [(e, i + 1, None, None if x is None else float(x), sum(i >= c for c in cuts[e])) for i, (_, x) in enumerate(seq)]
        sequences[e] = [x for _, x in seq]
    rows = spark.createDataFrame(rows, "eqmt int, time_created long, raw string, liters double, part int")
    parts = merged_copies(rows.drop("part"), "liters").join(rows.select("eqmt", "time_created", "part"), ["eqmt", "time_created"])
    states = _states(_runs(in_order(parts, ("eqmt", "part"), "liters"), ("eqmt", "part")), 100, ("eqmt", "part"))
    listed = states.groupBy("eqmt").agg(F.array_sort(F.collect_list(F.struct("part", "state"))).alias("s"))
    join = _combine(100)
    left = f"aggregate(transform(slice(s, 2, size(s)), x -> x.state), s[0].state, (a, b) -> {join})"
    back = "reverse(transform(s, x -> x.state))"
    right = f"aggregate(slice({back}, 2, size(s)), {back}[0], (b, a) -> {join})"
    got = listed.select("eqmt", F.expr(left).alias("l"), F.expr(right).alias("r"))
    got = got.select("eqmt", _consumed(F.col("l"), 100).alias("l"), _consumed(F.col("r"), 100).alias("r")).collect()
    assert len(got) > 50
    for r in got:
        want = loop_confirmed(sequences[r.eqmt])
        assert r.l == pytest.approx(want, abs=1e-6) and r.r == pytest.approx(want, abs=1e-6)


def test_a_crowded_hour_spreads_over_several_tasks(spark):
    """A million readings of one machine in one hour: no task sorts more than a unit of them."""
    from tankline.operators.slots import in_order, merged_copies
    from tankline.operators.spans import unit_of
    from tankline.operators.sweeps import UNIT_MS

    t = ms("2024-01-01 00:00:00")
    rows = spark.range(0, 1_000_000, 1, 8).selectExpr(
        "1 AS eqmt", f"{t} + id * 36 div 10 AS time_created", "'' AS raw", "double(1000 - (id % 977)) AS liters"
    )
    placed = merged_copies(rows, "liters").withColumn("unit", unit_of(F.col("time_created"), UNIT_MS))
    sizes = in_order(placed, ("eqmt", "unit"), "liters").groupBy("unit").agg(F.max("n").alias("n")).collect()
    assert len(sizes) >= 4 and max(r.n for r in sizes) <= 250_000
    minutes = windows_of(spark, [(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00")])
    split = {"slot_ms": 60_000}
    used = [ops.fuel_used_raw_drops(rows, minutes, **o).first().fuel_used for o in ({}, split)]
    assert used[0] == used[1] == sum(1 for i in range(999_999) if i % 977 != 976)


def test_reversed_requests_get_the_same_answer_alone_and_in_a_batch(spark):
    readings = readings_of(spark, [(1, "2024-01-01 00:00:00", 300), (1, "2024-01-10 00:00:00", 100)])
    back = (1, "2024-01-12 00:00:00", "2024-01-05 00:00:00")
    others = [(1, "2024-01-05 00:00:00", "2024-01-12 00:00:00"), (1, "2024-01-05 00:00:00", "2024-01-06 00:00:00")]
    for asked in ([back], [back, *others]):
        rows = ops.fuel_level_difference(readings, windows_of(spark, asked)).collect()
        assert [(r.consumption, r.status) for r in rows if r.time_from > r.time_to] == [(-200.0, "ok")]


def test_compared_methods_keep_every_request(spark):
    from .conftest import requests_of, shifts_of

    readings = readings_of(spark, [(1, "2024-01-01 09:00:00", 300), (1, "2024-01-03 09:00:00", 100)])
    rows = [(1, "2024-01-01", 1, "2024-01-02", 2), (1, "2024-01-01", 1, "2024-01-02", None), (2, "2024-01-01", None, "2024-01-02", 1)]
    got = ops.compare_methods(readings, shifts_of(spark, days=5), requests_of(spark, rows)).collect()
    assert sorted(str((r.eqmt, r.startshift, r.endshift)) for r in got) == sorted(str((e, s, n)) for e, _, s, _, n in rows)


def test_quality_of_requests_equals_the_single_range(spark, data):
    from tankline.operators.quality import LOOSE_LIMITS

    readings, _ = data
    t0, t1 = ms("2024-01-01 00:10:07") // 1000, ms("2024-01-01 05:03:01") // 1000
    asked = spark.createDataFrame([(e, t0 + k, t1) for e in MACHINES for k in (0, 1800)], "eqmt int, t0 long, t1 long")
    got = {(r.eqmt, r.t0): (r.fuel_used, r.status, r.accuracy) for r in ops.fuel_usage_quality_requests(readings, asked, limits=LOOSE_LIMITS).collect()}
    for k in (0, 1800):
        want = {int(r.eqmtid): (r.fuel_used, r.status, r.accuracy) for r in ops.fuel_usage_quality(readings, t0 + k, t1, limits=LOOSE_LIMITS).collect()}
        for e in MACHINES:
            assert got[e, t0 + k] == pytest.approx(want.get(e, (None, "no_levels", None)))

"""The same answers in plain SQL, written the long way: scalar lookups for the
calendar and row-by-row recursion for the state machines."""

from __future__ import annotations

from .tables import CLEAN_LIMITS, DROP_LIMITS, MONTH, REPORT_LIMITS, TEN_DAYS, WINDOWS

#: Queries that are also put to readings with unknown levels, copies and ties.
EDGE_QUERIES = (
    "fuel_usage_quality",
    "fuel_used_first_last",
    "fuel_level_difference",
    "fuel_used_raw_drops",
    "analyze_fuel",
    "fuel_between_confirmed_refills",
)

FROM_TIME, TO_TIME = "2024-01-05 08:45:00", "2024-01-25 20:45:00"


def _bucket(ms: str, minutes: int) -> str:
    """Whole buckets since the hour, by arithmetic on epoch milliseconds."""
    width = minutes * 60_000
    return f"epoch_ms({ms} - {ms} % 3600000 + {ms} % 3600000 // {width} * {width})"


def _floor(ts: str) -> str:
    """Start of the shift in which a time lies."""
    moved = f"({ts} + INTERVAL 195 MINUTE)"
    return (
        f"(date_trunc('day', {moved})::TIMESTAMP - INTERVAL 195 MINUTE"
        f" + CASE WHEN hour({moved}) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END)"
    )


_READINGS = """readings AS (
  SELECT epoch_us(ts) // 1000 AS time_created, CAST(user_id AS INTEGER) AS eqmt, props AS raw, value AS liters
  FROM events)"""

_EDGE_READINGS = """readings AS (
  SELECT CASE WHEN event_id % 11 < 5 THEN epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 14400000 ELSE epoch_us(ts) // 1000 END AS time_created,
    CAST(user_id AS INTEGER) AS eqmt, props AS raw, CASE WHEN event_id % 17 <> 0 THEN value END AS liters
  FROM (SELECT *, unnest(range(CASE WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END)) FROM events))"""

_SHIFTS = f"""edges AS (SELECT epoch_ms(min(time_created)) AS a, epoch_ms(max(time_created)) AS b FROM readings),
starts AS (
  SELECT unnest(generate_series({_floor("a")} - INTERVAL 12 HOUR, {_floor("b")} + INTERVAL 12 HOUR,
    INTERVAL 12 HOUR)) AS shiftstart FROM edges),
shifts AS (
  SELECT shiftstart,
    CASE WHEN hour(shiftstart) = 20 THEN CAST(shiftstart AS DATE) + 1 ELSE CAST(shiftstart AS DATE) END::DATE AS shiftdate,
    CASE WHEN hour(shiftstart) = 20 THEN 1 ELSE 2 END AS shift, CAST(NULL AS INTEGER) AS crew
  FROM starts)"""


def _resampled(name: str, minutes: int, where: str = "TRUE") -> str:
    return f"""{name}_means AS (
  SELECT eqmt, {_bucket("time_created", minutes)} AS tm, round(avg(liters), 9) AS fuel
  FROM readings WHERE {where} GROUP BY ALL),
{name} AS (
  SELECT *, lag(fuel) OVER (PARTITION BY eqmt ORDER BY tm) AS fuel_prev FROM {name}_means)"""


def _seconds(bounds: tuple[int, int]) -> str:
    return f"time_created // 1000 BETWEEN {bounds[0]} AND {bounds[1]}"


def _fixed3(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,9)), 3) AS DECIMAL(18,3))"


_LEVELS = (
    _resampled("fine", 5)
    + f""",
levels AS (
  SELECT tm AS timecreated, CAST(eqmt AS VARCHAR) AS eqmt, {_fixed3("fuel")} AS liters,
    {_fixed3("fuel_prev")} AS liters_prev FROM fine)"""
)

_REQUESTS = (
    "requests AS (SELECT eqmt, startdate, startshift, enddate, endshift"
    " FROM (SELECT DISTINCT eqmt FROM readings) CROSS JOIN (VALUES "
    + ", ".join(f"(DATE '{a}', {b}, DATE '{c}', {'NULL' if d is None else d})" for a, b, c, d in WINDOWS)
    + ") AS w(startdate, startshift, enddate, endshift))"
)

_SECOND_REQUESTS = (
    "second_requests AS (SELECT eqmt, t0, t1 FROM (SELECT DISTINCT eqmt FROM readings) CROSS JOIN (VALUES "
    + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in (MONTH, TEN_DAYS))
    + ") AS w(t0, t1))"
)

_ENTRIES = f"""entries AS (
  SELECT epoch_us(ts) // 1000 AS time_created, CAST(user_id AS INTEGER) AS eqmt,
    CAST(1000 + floor((epoch_us(ts) // 1000 - {MONTH[0]}000) / 3600000.0::DOUBLE * 0.6::DOUBLE)
      + CASE WHEN event_type = 'signup' THEN 50 ELSE 0 END AS INTEGER) AS engrs
  FROM events)"""

_IDLE = """idle AS (
  SELECT CAST(user_id AS INTEGER) AS eqmt, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS status,
    epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + 3600000 AS b
  FROM events WHERE event_type IN ('error', 'click'))"""

# Bounds by scalar lookup, as a call would find them.
_START = "(SELECT min(shiftstart) FROM shifts s WHERE s.shiftdate = r.startdate AND s.shift = r.startshift)"
_END = "(SELECT min(shiftstart) FROM shifts s WHERE s.shiftdate = r.enddate AND s.shift = r.endshift)"
_ENDS = {
    "plus_12h": "end_at + INTERVAL 12 HOUR",
    "plus_12h_rollover": "CASE WHEN end_at + INTERVAL 12 HOUR <= start_at THEN end_at + INTERVAL 36 HOUR"
    " ELSE end_at + INTERVAL 12 HOUR END",
    "next_or_last_reading": "CASE WHEN end_at IS NOT NULL THEN coalesce("
    "(SELECT min(shiftstart) FROM shifts s WHERE s.shiftstart > end_at),"
    " (SELECT epoch_ms(max(time_created)) FROM readings h WHERE h.eqmt = q.eqmt)) END",
    "next_or_12h": "coalesce((SELECT min(shiftstart) FROM shifts s WHERE s.shiftstart > end_at), end_at + INTERVAL 12 HOUR)",
    "next_only": "(SELECT min(shiftstart) FROM shifts s WHERE s.shiftstart > end_at)",
    "one_shift": "(SELECT min(shiftstart) FROM shifts s WHERE s.shiftstart > start_at)",
    "next_by_number": "coalesce((SELECT arg_min(shiftstart, (shiftdate, shift)) FROM shifts s"
    " WHERE s.shiftdate > enddate OR (s.shiftdate = enddate AND s.shift > endshift)),"
    " (SELECT epoch_ms(max(time_created)) FROM readings h WHERE h.eqmt = q.eqmt"
    " AND h.time_created >= epoch_ms(start_at)))",
    "end_shift_start": "coalesce(end_at, (SELECT min(shiftstart) FROM shifts s WHERE s.shiftstart > start_at),"
    " start_at + INTERVAL 12 HOUR)",
}


def _intervals(rule: str, validate: bool = False) -> str:
    invalid = (
        "WHEN startdate > enddate OR (startdate = enddate AND startshift > endshift) THEN 'invalid_interval' "
        if validate
        else ""
    )
    if rule in ("calendar_days", "calendar_days_full"):
        extra = 1 if rule == "calendar_days_full" else 0
        bounds = (
            "SELECT *, CAST(startdate AS TIMESTAMP) AS time_from,"
            f" CAST(enddate + {extra} AS TIMESTAMP) AS time_to FROM requests"
        )
    else:
        bounds = (
            f"SELECT eqmt, startdate, startshift, enddate, endshift, start_at AS time_from, {_ENDS[rule]} AS time_to"
            f" FROM (SELECT r.*, {_START} AS start_at, {_END} AS end_at FROM requests r) q"
        )
    return f"""intervals AS (
  SELECT *, epoch_ms(time_from) AS from_ms, epoch_ms(time_to) AS to_ms,
    CASE {invalid}WHEN time_from IS NULL THEN 'start_missing' WHEN time_to IS NULL THEN 'end_missing'
      ELSE 'ok' END AS bounds_status
  FROM ({bounds}))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


_I = "i.eqmt, i.startdate, i.startshift, i.enddate, i.endshift, i.time_from, i.time_to, i.from_ms, i.to_ms, i.bounds_status"


def _r6(x: str) -> str:
    """Six places, by way of ten so that binary noise cannot tip a tie."""
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), 6) AS DOUBLE)"


def _interval_query(rule: str, validate: bool = False) -> str:
    return _with(_READINGS, _SHIFTS, _REQUESTS, _intervals(rule, validate)) + "SELECT * FROM intervals"


def _on_levels(rule: str, measures: str, closed: str = "<=", group: str = _I) -> str:
    """Measures over ``d = liters_prev - liters`` of an interval's levels, empty ones kept."""
    return _with(_READINGS, _SHIFTS, _REQUESTS, _LEVELS, _intervals(rule)) + f"""
SELECT {group}, {measures}
FROM intervals i LEFT JOIN (SELECT *, liters_prev - liters AS d FROM levels) v
  ON v.eqmt = CAST(i.eqmt AS VARCHAR) AND i.bounds_status = 'ok'
  AND v.timecreated >= i.time_from AND v.timecreated {closed} i.time_to
GROUP BY {group}"""


def _if_ok(x: str) -> str:
    return f"CASE WHEN i.bounds_status = 'ok' THEN {x} END"


def _ordered(rule: str, closed: str, validate: bool = False) -> str:
    """Raw readings of each distinct interval, numbered in order."""
    return ",\n".join(
        [
            _READINGS,
            _SHIFTS,
            _REQUESTS,
            _intervals(rule, validate),
            f"""seq AS (
  SELECT i.eqmt, i.from_ms, i.to_ms, h.liters,
    row_number() OVER (PARTITION BY i.eqmt, i.from_ms, i.to_ms ORDER BY h.time_created, h.liters NULLS FIRST) AS n,
    count(*) OVER (PARTITION BY i.eqmt, i.from_ms, i.to_ms) AS total_n
  FROM (SELECT DISTINCT eqmt, from_ms, to_ms FROM intervals WHERE bounds_status = 'ok') i
  JOIN readings h ON h.eqmt = i.eqmt AND h.time_created >= i.from_ms AND h.time_created {closed} i.to_ms)""",
        ]
    )


def _quality(minutes: int, bounds: tuple[int, int], limits=(70, 250, 0.8, 0.1)) -> str:
    return _with(_READINGS, _resampled("main", minutes, _seconds(bounds))) + _verdict(
        "main", "CAST(eqmt AS VARCHAR) AS eqmtid", "eqmt", limits
    )


_LIMITS = ("max_fuel_diff", "min_fueling_level", "perc_no_data", "perc_need_cab")
_ASKED = "eqmt, t0, t1, " + ", ".join(_LIMITS)


def _verdict(source: str, names: str, keys: str, limits=(70, 250, 0.8, 0.1)) -> str:
    """One label per group first; what is shown follows from the label."""
    top, fueling, no_data, need_cab = limits
    return f"""SELECT {names}, status,
  CASE status WHEN 'Ok' THEN {_r6("used")} END AS fuel_used,
  CASE WHEN status <> 'no_data' THEN CAST(round(CAST(100.0::DOUBLE * jumps / points AS DECIMAL(30,10)), 1) AS DOUBLE) END AS accuracy
FROM (
  SELECT *, CASE WHEN flat > {no_data}::DOUBLE * points THEN 'no_data'
    WHEN jumps > {need_cab}::DOUBLE * points THEN 'need calibration' ELSE 'Ok' END AS status
  FROM (
    SELECT {keys}, CAST(count(*) AS DOUBLE) AS points, count(*) FILTER (fall = 0) AS flat,
      coalesce(sum(fall) FILTER (fall > 0 AND fall < {top}), 0) AS used,
      count(*) FILTER (fall > {top} OR (fall > -{fueling} AND fall < -{top})) AS jumps
    FROM (SELECT *, fuel_prev - fuel AS fall FROM {source} WHERE fuel > 0 AND fuel_prev > 0)
    GROUP BY {keys}))"""


def _report(rise_limit: float | str, leap_limit: float | str) -> str:
    return f"""{_r6("coalesce(sum(d) FILTER (d > 0), 0)")} AS fuel_used, count(*) AS valid_points,
  CASE WHEN 100 * count(*) FILTER (d < 0) > {rise_limit} * count(*) THEN 'no_data'
    WHEN 100 * count(*) FILTER (d < -15) > {leap_limit} * count(*) THEN 'need calibration'
    ELSE 'ok' END AS status"""


_DROPS = "round(coalesce(sum(d) FILTER (WHERE d > 0{cap}), 0), 1)"


def _drops(rule: str, cap: str = "") -> str:
    return _on_levels(rule, f"{_if_ok(_r6(_DROPS.format(cap=cap)))} AS fuel_used")


def _clean(rule: str, rise_cap: str) -> str:
    drop = "d > 0 AND d <= 200"
    rise = f"d < 0 AND -d > 150{rise_cap}"
    return _on_levels(
        rule,
        f"{_if_ok(_r6(f'round(coalesce(sum(d) FILTER (WHERE {drop}), 0), 1)'))} AS total_used,"
        f" {_if_ok(_r6(f'round(coalesce(sum(-d) FILTER (WHERE {rise}), 0), 1)'))} AS total_refueled,"
        f" {_if_ok(f'CAST(count(*) FILTER (WHERE ({drop}) OR ({rise})) AS INTEGER)')} AS valid_points,"
        f" {_if_ok('CAST(count(d) AS INTEGER)')} AS total_points",
    )


def _clean_limits(rise_cap: str) -> str:
    drop = "d > 0 AND d <= coalesce(max_step_drop, 200)"
    rise = f"d < 0 AND -d > coalesce(refuel_threshold, 150){rise_cap}"
    return _on_limited(
        "plus_12h_rollover",
        CLEAN_LIMITS,
        f"{_if_ok(_r6(f'round(coalesce(sum(d) FILTER (WHERE {drop}), 0), 1)'))} AS total_used,"
        f" {_if_ok(_r6(f'round(coalesce(sum(-d) FILTER (WHERE {rise}), 0), 1)'))} AS total_refueled,"
        f" {_if_ok(f'CAST(count(*) FILTER (WHERE ({drop}) OR ({rise})) AS INTEGER)')} AS valid_points,"
        f" {_if_ok('CAST(count(d) AS INTEGER)')} AS total_points",
    )


def _on_limited(rule: str, limits: dict[str, str], measures: str) -> str:
    """The same with limits of each request's own."""
    own = ", ".join(f"{x} AS {name}" for name, x in limits.items())
    group = ", ".join([_I, *limits])
    on_levels = _on_levels(rule, measures, group=group)
    return on_levels.replace("FROM intervals i", f"FROM (SELECT *, {own} FROM intervals) i")


def _segments(tail: str) -> str:
    return (
        _with(
            _READINGS,
            _SHIFTS,
            _REQUESTS,
            _LEVELS,
            _intervals("plus_12h_rollover"),
            """seg AS (
  SELECT i.eqmt, i.from_ms, i.to_ms, liters_prev - liters AS d,
    count(*) FILTER (liters > liters_prev + 150) OVER (
      PARTITION BY i.eqmt, i.from_ms, i.to_ms ORDER BY timecreated) AS seg_no
  FROM (SELECT DISTINCT eqmt, from_ms, to_ms, time_from, time_to FROM intervals WHERE bounds_status = 'ok') i
  JOIN levels v ON v.eqmt = CAST(i.eqmt AS VARCHAR) AND v.timecreated BETWEEN i.time_from AND i.time_to)""",
            """per_seg AS (
  SELECT eqmt, from_ms, to_ms, seg_no, sum(d) FILTER (WHERE d > 0 AND d < 200) AS seg_consumption
  FROM seg GROUP BY ALL)""",
        )
        + tail
    )


def _level_at(edge: str) -> str:
    return (
        # A level in a struct: arg_max passes over a bare NULL, but the newest reading counts as it is.
        f"(SELECT arg_max(struct_pack(x := h.liters), (h.time_created, h.liters IS NOT NULL, coalesce(h.liters, 0))).x"
        f" FROM readings h WHERE h.eqmt = i.eqmt AND h.time_created <= i.{edge})"
    )


_LEVEL_DIFFERENCE = f"""SELECT {_I}, {_r6("start_level")} AS start_level, {_r6("end_level")} AS end_level,
  CASE WHEN bounds_status = 'start_missing' THEN 0.0::DOUBLE WHEN bounds_status = 'ok'
    THEN {_r6("start_level - end_level")} END AS consumption,
  CASE WHEN bounds_status <> 'ok' THEN bounds_status WHEN start_level IS NULL OR end_level IS NULL
    THEN 'no_level' ELSE 'ok' END AS status
FROM (SELECT i.*, CASE WHEN bounds_status = 'ok' THEN {_level_at("from_ms")} END AS start_level,
        CASE WHEN bounds_status = 'ok' THEN {_level_at("to_ms")} END AS end_level FROM intervals i) i"""


def _raw_drops() -> str:
    return (
        _with(_ordered("next_only", "<="))
        + f"""SELECT {_I}, {_r6("coalesce(u.used, 0)")} AS fuel_used
FROM intervals i LEFT JOIN (
  SELECT eqmt, from_ms, to_ms, sum(prev - liters) FILTER (WHERE liters < prev) AS used
  FROM (SELECT *, lag(liters) OVER (PARTITION BY eqmt, from_ms, to_ms ORDER BY n) AS prev FROM seq WHERE liters IS NOT NULL)
  GROUP BY ALL) u ON u.eqmt = i.eqmt AND u.from_ms = i.from_ms AND u.to_ms = i.to_ms"""
    )


def _analysis() -> str:
    """The reading loop, one recursion step per reading."""
    return (
        _with(
            _ordered("next_or_12h", "<"),
            """walk AS (
  SELECT eqmt, from_ms, to_ms, n, total_n, liters AS first_level, liters AS last, liters AS seg,
    0.0::DOUBLE AS used, 0.0::DOUBLE AS refilled, 0 AS refills, 0 AS anomalies
  FROM seq WHERE n = 1
  UNION ALL
  SELECT s.eqmt, s.from_ms, s.to_ms, s.n, s.total_n, w.first_level, s.liters,
    CASE WHEN round(s.liters - w.last, 8) > 40 THEN s.liters ELSE w.seg END,
    CASE WHEN round(s.liters - w.last, 8) > 40 THEN w.used + (w.seg - w.last) ELSE w.used END,
    CASE WHEN round(s.liters - w.last, 8) > 40 THEN w.refilled + (s.liters - w.last) ELSE w.refilled END,
    CASE WHEN round(s.liters - w.last, 8) > 40 THEN w.refills + 1 ELSE w.refills END,
    CASE WHEN round(s.liters - w.last, 8) < -100 THEN w.anomalies + 1 ELSE w.anomalies END
  FROM walk w JOIN seq s ON s.eqmt = w.eqmt AND s.from_ms = w.from_ms AND s.to_ms = w.to_ms AND s.n = w.n + 1)""",
            """ended AS (
  SELECT *, round(used + CASE WHEN seg > last THEN seg - last ELSE 0 END, 8) AS consumed
  FROM walk WHERE n = total_n)""",
            recursive=True,
        )
        + f"""SELECT {_I},
  CASE WHEN e.n IS NULL THEN 0.0::DOUBLE ELSE {_r6("consumed")} END AS total_consumption_liters,
  {_r6("coalesce(refilled, 0)")} AS total_refilled_liters,
  coalesce(refills, 0) AS refills_count, coalesce(anomalies, 0) AS anomalous_drops_count,
  CASE WHEN i.to_ms > i.from_ms AND consumed > 0 THEN {_r6("consumed / ((i.to_ms - i.from_ms) / 3600000.0::DOUBLE)")}
    ELSE 0.0::DOUBLE END AS avg_consumption_lph,
  {_r6("first_level")} AS start_fuel_level, {_r6("last")} AS end_fuel_level,
  CAST(coalesce(e.n, 0) AS BIGINT) AS data_points_processed
FROM intervals i LEFT JOIN ended e ON e.eqmt = i.eqmt AND e.from_ms = i.from_ms AND e.to_ms = i.to_ms
  AND i.bounds_status = 'ok'"""
    )


_MACHINE = """walk AS (
  SELECT eqmt, from_ms, to_ms, n, total_n, 'C' AS state, liters AS last, liters AS seg, liters AS low,
    0.0::DOUBLE AS inc, 0.0::DOUBLE AS used
  FROM seq WHERE n = 1
  UNION ALL
  SELECT eqmt, from_ms, to_ms, n, total_n,
    CASE WHEN ev = 'rise' THEN 'P' WHEN ev = 'confirm' THEN 'F' WHEN ev IN ('back', 'peak') THEN 'C' ELSE state END,
    c,
    CASE WHEN ev = 'peak' THEN last ELSE seg END,
    CASE WHEN ev IN ('lower', 'peak') THEN c WHEN ev = 'back' THEN least(low, c) ELSE low END,
    CASE WHEN ev = 'rise' THEN c - last WHEN ev IN ('more', 'confirm') THEN inc + (c - last) ELSE inc END,
    CASE WHEN ev = 'confirm' AND seg > low THEN used + (seg - low) ELSE used END
  FROM (
    SELECT w.eqmt, w.from_ms, w.to_ms, s.n, w.total_n, w.state, w.last, w.seg, w.low, w.inc, w.used, s.liters AS c,
      CASE WHEN w.state = 'C' THEN CASE WHEN s.liters < w.low THEN 'lower' WHEN s.liters > w.last THEN 'rise' END
        WHEN w.state = 'P' THEN CASE WHEN s.liters > w.last AND round(w.inc + (s.liters - w.last), 8) >= 100 THEN 'confirm'
          WHEN s.liters > w.last THEN 'more' WHEN s.liters < w.last THEN 'back' END
        WHEN w.state = 'F' THEN CASE WHEN s.liters < w.last THEN 'peak' END END AS ev
    FROM walk w JOIN seq s ON s.eqmt = w.eqmt AND s.from_ms = w.from_ms AND s.to_ms = w.to_ms AND s.n = w.n + 1))"""


def _confirmed_refills() -> str:
    return (
        _with(
            _ordered("next_or_last_reading", "<", validate=True),
            _MACHINE,
            """ended AS (
  SELECT *, used + CASE WHEN state IN ('C', 'P') AND seg > low THEN seg - low ELSE 0 END AS consumed
  FROM walk WHERE n = total_n)""",
            recursive=True,
        )
        + f"""SELECT {_I}, CASE WHEN i.bounds_status = 'invalid_interval' THEN NULL
    ELSE {_r6("coalesce(consumed, 0)")} END AS consumption
FROM intervals i LEFT JOIN ended e ON e.eqmt = i.eqmt AND e.from_ms = i.from_ms AND e.to_ms = i.to_ms
  AND i.bounds_status = 'ok'"""
    )


def _idle_of(a: str, b: str, outer: str) -> str:
    return (
        "coalesce((SELECT sum(greatest(0, least(d.b, 1000 * {b}) - greatest(d.a, 1000 * {a})))"
        " FROM idle d WHERE d.eqmt = {o}.eqmt AND d.status IN (1, 3)), 0) / 1000.0::DOUBLE"
    ).format(a=a, b=b, o=outer)


def _engine_hours(literal: bool) -> str:
    base = _with(
        _READINGS,
        _SECOND_REQUESTS,
        _ENTRIES,
        _IDLE,
        """kept AS (
  SELECT eqmt, t0, t1, count(*) AS kept, max(engrs) - min(engrs) AS gain,
    min(time_created) // 1000 AS first_s, max(time_created) // 1000 AS last_s
  FROM (
    SELECT q.eqmt, q.t0, q.t1, e.engrs, e.time_created,
      lag(e.engrs) OVER w AS prv, lag(e.time_created) OVER w AS prv_time
    FROM second_requests q JOIN entries e
      ON e.eqmt = q.eqmt AND e.engrs > 0 AND e.time_created // 1000 BETWEEN q.t0 AND q.t1
    WINDOW w AS (PARTITION BY q.eqmt, q.t0, q.t1 ORDER BY e.time_created, e.engrs))
  WHERE engrs - prv > 0 AND engrs - prv <= (time_created - prv_time) / 3600000.0::DOUBLE + 1
  GROUP BY eqmt, t0, t1)""",
    )
    whole = f"(q.t1 - q.t0 - {_idle_of('q.t0', 'q.t1', 'q')}) / 3600.0::DOUBLE"
    if literal:
        return base + (
            f"SELECT q.eqmt, q.t0, q.t1, 0 AS kept, {_r6(whole)} AS engine_hours FROM second_requests q"
        )
    return (
        base
        + f"""SELECT q.eqmt, q.t0, q.t1, CAST(coalesce(k.kept, 0) AS INTEGER) AS kept,
  CASE WHEN k.kept > 1 THEN CAST(round(CAST(k.gain
      + (q.t1 - k.last_s - {_idle_of('k.last_s', 'q.t1', 'q')}) / 3600.0::DOUBLE
      + (k.first_s - q.t0 - {_idle_of('q.t0', 'k.first_s', 'q')}) / 3600.0::DOUBLE AS DECIMAL(30,10)), 1) AS DOUBLE)
    ELSE {_r6(whole)} END AS engine_hours
FROM second_requests q LEFT JOIN kept k ON k.eqmt = q.eqmt AND k.t0 = q.t0 AND k.t1 = q.t1"""
    )


def _levels_query(columns: str, tail: str = "") -> str:
    return _with(_READINGS, _LEVELS) + f"SELECT {columns} FROM levels {tail}"


def _readings_query(columns: str, tail: str = "") -> str:
    return _with(_READINGS) + f"SELECT {columns} FROM readings {tail}"


_LEVEL_COLUMNS = f"timecreated, eqmt, {_r6('liters')} AS liters, {_r6('liters_prev')} AS liters_prev"
_RANGE = f"timecreated BETWEEN TIMESTAMP '{FROM_TIME}' AND TIMESTAMP '{TO_TIME}'"


def _resample_query(minutes: int, where: str = "TRUE", previous: bool = False) -> str:
    more = f", {_r6('fuel_prev')} AS fuel_prev" if previous else ""
    return (
        _with(_READINGS, _resampled("main", minutes, where))
        + f"SELECT tm, eqmt, {_r6('fuel')} AS fuel{more} FROM main"
    )


def _fine_query(where: str) -> str:
    return (
        _with(_READINGS, _resampled("main", 5, where))
        + f"SELECT tm, CAST(eqmt AS VARCHAR) AS eqmt, {_r6(_fixed3('fuel'))} AS fuel,"
        f" {_r6(_fixed3('fuel_prev'))} AS fuel_prev FROM main"
    )


def _shift_query(columns: str = "*", tail: str = "") -> str:
    return _with(_READINGS, _SHIFTS) + f"SELECT {columns} FROM shifts {tail}"


def oracles() -> dict[str, str]:
    fall, rise = "liters_prev - liters", "liters - liters_prev"
    trace = f"eqmt, timecreated, {_r6('liters')} AS liters, {_r6('liters_prev')} AS liters_prev"
    by_shift = _with(
        _READINGS,
        _SHIFTS,
        _resampled("main", 10, _seconds(MONTH)),
        """cut AS (
  SELECT m.*, CAST(epoch_ms(sh.shiftstart) // 1000 AS BIGINT) AS shiftstart_epoch
  FROM main m LEFT JOIN shifts sh ON m.tm BETWEEN sh.shiftstart AND sh.shiftstart + INTERVAL 12 HOUR)""",
    ) + _verdict("cut", "eqmt AS eqmtid, shiftstart_epoch", "eqmt, shiftstart_epoch")
    by_shift_requests = _with(
        _READINGS,
        _SHIFTS,
        _SECOND_REQUESTS,
        f"""asked AS (SELECT *, CASE t0 WHEN {TEN_DAYS[0]} THEN 50.0::DOUBLE ELSE 70.0::DOUBLE END AS max_fuel_diff FROM second_requests)""",
        f"""means AS (SELECT a.*, {_bucket("h.time_created", 10)} AS tm, round(avg(h.liters), 9) AS fuel FROM asked a JOIN readings h
  ON h.eqmt = a.eqmt AND h.time_created // 1000 BETWEEN a.t0 AND a.t1 GROUP BY ALL)""",
        "main AS (SELECT *, lag(fuel) OVER (PARTITION BY eqmt, t0, t1 ORDER BY tm) AS fuel_prev FROM means)",
        """cut AS (
  SELECT m.*, CAST(epoch_ms(sh.shiftstart) // 1000 AS BIGINT) AS shiftstart_epoch
  FROM main m LEFT JOIN shifts sh ON m.tm BETWEEN sh.shiftstart AND sh.shiftstart + INTERVAL 12 HOUR)""",
    ) + _verdict("cut", "eqmt, t0, t1, max_fuel_diff, shiftstart_epoch", "eqmt, t0, t1, max_fuel_diff, shiftstart_epoch", ("max_fuel_diff", 250, 0.8, 0.1))
    all_shifts = _with(
        _READINGS,
        _SHIFTS,
        _LEVELS,
        "spans AS (SELECT shiftstart AS time_from, lead(shiftstart) OVER (ORDER BY shiftstart) AS time_to FROM shifts)",
    ) + f"""SELECT CAST(v.eqmt AS INTEGER) AS eqmt_id, s.time_from, s.time_to, {_report(80, 30)}
FROM spans s JOIN (SELECT *, liters_prev - liters AS d FROM levels) v
  ON v.timecreated >= s.time_from AND v.timecreated < s.time_to
GROUP BY 1, 2, 3"""
    window = _with(_READINGS, _LEVELS) + f"""
SELECT CAST(eqmt AS INTEGER) AS eqmt_id, TIMESTAMP '{FROM_TIME}' AS time_from, TIMESTAMP '{TO_TIME}' AS time_to,
  {_report(60, 40)}
FROM (SELECT *, liters_prev - liters AS d FROM levels)
WHERE timecreated >= TIMESTAMP '{FROM_TIME}' AND timecreated < TIMESTAMP '{TO_TIME}' GROUP BY eqmt"""
    requested = (
        _with(_READINGS, _SHIFTS, _REQUESTS, _LEVELS, _intervals("one_shift"))
        + f"""SELECT i.eqmt AS eqmt_id, i.time_from, i.time_to, {_report(80, 30)}
FROM intervals i JOIN (SELECT *, liters_prev - liters AS d FROM levels) v
  ON v.eqmt = CAST(i.eqmt AS VARCHAR) AND v.timecreated >= i.time_from AND v.timecreated < i.time_to
GROUP BY i.eqmt, i.startdate, i.startshift, i.enddate, i.endshift, i.time_from, i.time_to"""
    )
    level_difference = (
        _with(_READINGS, _SHIFTS, _REQUESTS, _intervals("next_by_number")) + _LEVEL_DIFFERENCE
    )
    keys = "eqmt, startdate, startshift, enddate, endshift"
    same = lambda other: " AND ".join(f"a.{k} IS NOT DISTINCT FROM {other}.{k}" for k in keys.split(", "))
    compare = f"""SELECT a.eqmt, a.startdate, a.startshift, a.enddate, a.endshift, level_difference, raw_drops,
  refuel_stretches, confirmed_refills
FROM (SELECT {keys}, consumption AS level_difference FROM ({level_difference})) a
JOIN (SELECT {keys}, fuel_used AS raw_drops FROM ({_raw_drops()})) b ON {same("b")}
JOIN (SELECT {keys}, total_consumption_liters AS refuel_stretches FROM ({_analysis()})) c ON {same("c")}
JOIN (SELECT {keys}, consumption AS confirmed_refills FROM ({_confirmed_refills()})) d ON {same("d")}"""
    bucket_columns = ", ".join(f"{_bucket('time_created', n)} AS bucket_{n}" for n in (20, 10, 5, 25))
    at = "epoch_ms(time_created)"

    out = {
        "read_readings_mapped": "SELECT event_id AS time_created, CAST(user_id AS INTEGER) AS eqmt,"
        f" props AS raw, {_r6('value')} AS liters FROM events",
        "readings_of_events": _readings_query(f"time_created, eqmt, raw, {_r6('liters')} AS liters"),
        "read_shifts": _shift_query(),
        "read_shifts_wide": _shift_query(
            "*, 43200 AS length, CAST(epoch_ms(shiftstart) // 1000 AS BIGINT) AS shiftstart_epoch"
        ),
        "read_engine_hours": _with(_ENTRIES)
        + f"SELECT * FROM entries WHERE engrs > 0 AND {_seconds(TEN_DAYS)}",
        "level_csv_round_trip": _levels_query(_LEVEL_COLUMNS),
        "materialized_levels": _levels_query(_LEVEL_COLUMNS),
        "refreshed_levels": _levels_query(_LEVEL_COLUMNS),
        "epoch_to_timestamp": _readings_query(
            f"time_created, eqmt, epoch_ms(time_created // 1000 * 1000) AS whole_second, {at} AS exact"
        ),
        "time_buckets": _readings_query(f"time_created, eqmt, {bucket_columns}"),
        "time_buckets_modulo": _readings_query(
            "time_created, eqmt, epoch_ms(time_created - time_created % 600000) AS m10"
        ),
        "range_filter": _readings_query(
            f"time_created, eqmt, raw, {_r6('liters')} AS liters", f"WHERE {_seconds(TEN_DAYS)}"
        ),
        "resample_avg_20": _resample_query(20, _seconds(MONTH)),
        "resample_avg_10": _resample_query(10),
        "resample_avg_5": _resample_query(5),
        "with_previous": _resample_query(20, previous=True),
        "levels_5min": _levels_query(_LEVEL_COLUMNS),
        "levels_5min_ranged": _fine_query(_seconds(TEN_DAYS)),
        "levels_5min_unranged": _fine_query("TRUE"),
        "readings_with_bucket": _readings_query(
            f"{_bucket('time_created', 5)} AS time_created_5m, {at} AS time_created_convert,"
            f" time_created, eqmt, raw, {_r6('liters')} AS liters"
        ),
        "level_trace_delta": _levels_query(
            f"{trace}, {_r6(f'round({rise}, 1)')} AS delta", f"WHERE {_RANGE}"
        ),
        "level_trace_fall": _levels_query(f"{trace}, {_r6(f'round({fall}, 3)')} AS delta"),
        "level_trace_fall_first": _levels_query(
            f"{trace}, {_r6(f'round({fall}, 3)')} AS delta", "ORDER BY timecreated, levels.eqmt LIMIT 1000"
        ),
        "level_trace_change": _levels_query(
            f"{trace}, {_r6(rise)} AS diff,"
            f" {_r6(f'CASE WHEN {rise} < 0 THEN abs({rise}) ELSE 0 END')} AS fuel_used"
        ),
        "level_trace_ranged": _fine_query(_seconds(MONTH)),
        "interval_of_seconds": _with(_READINGS, _SECOND_REQUESTS)
        + "SELECT *, t0 * 1000 AS from_ms, t1 * 1000 + 999 AS to_ms, epoch_ms(t0 * 1000) AS time_from,"
        " epoch_ms(t1 * 1000) AS time_to, 'ok' AS bounds_status FROM second_requests",
        "validate_interval": _with(_READINGS, _REQUESTS)
        + "SELECT *, coalesce(startdate > enddate OR (startdate = enddate AND startshift > endshift), false) AS invalid FROM requests",
        "fuel_usage_quality": _quality(20, MONTH),
        "fuel_usage_quality_by_shift": by_shift,
        "fuel_usage_quality_requests": _with(
            _READINGS,
            _SECOND_REQUESTS,
            f"""asked AS (SELECT *, CASE t0 WHEN {TEN_DAYS[0]} THEN 50.0::DOUBLE ELSE 70.0::DOUBLE END AS max_fuel_diff,
  250.0::DOUBLE AS min_fueling_level, 0.8::DOUBLE AS perc_no_data,
  CASE t0 WHEN {TEN_DAYS[0]} THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS perc_need_cab FROM second_requests)""",
            f"""means AS (SELECT a.*, h.time_created // 1200000 AS tm, round(avg(h.liters), 9) AS fuel FROM asked a JOIN readings h
  ON h.eqmt = a.eqmt AND h.time_created // 1000 BETWEEN a.t0 AND a.t1 GROUP BY ALL)""",
            "main AS (SELECT *, lag(fuel) OVER (PARTITION BY eqmt, t0, t1 ORDER BY tm) AS fuel_prev FROM means)",
        )
        + f"""SELECT a.eqmt, a.t0, a.t1, a.max_fuel_diff, a.min_fueling_level, a.perc_no_data, a.perc_need_cab, v.fuel_used,
  coalesce(v.status, 'no_levels') AS status, v.accuracy
FROM asked a LEFT JOIN ({_verdict("main", _ASKED, _ASKED, _LIMITS)}) v ON v.eqmt = a.eqmt AND v.t0 = a.t0 AND v.t1 = a.t1""",
        "fuel_usage_quality_loose_20": _quality(20, MONTH, (50, 10, 0.5, 0.3)),
        "fuel_usage_quality_loose_10": _quality(10, TEN_DAYS, (50, 10, 0.5, 0.3)),
        "fuel_used_first_last": _with(_READINGS, _SHIFTS, _REQUESTS, _intervals("plus_12h"))
        + f"""SELECT {_I}, {_r6("u.fuel_used")} AS fuel_used
FROM intervals i LEFT JOIN (
  SELECT eqmt, from_ms, to_ms,
    arg_min(struct_pack(x := mean), m10).x - arg_max(struct_pack(x := mean), m10).x AS fuel_used
  FROM (SELECT k.eqmt, k.from_ms, k.to_ms, avg(h.liters) AS mean,
          h.time_created // 600000 AS m10
        FROM (SELECT DISTINCT eqmt, from_ms, to_ms FROM intervals) k
        JOIN readings h ON h.eqmt = k.eqmt AND h.time_created BETWEEN k.from_ms AND k.to_ms GROUP BY ALL)
  GROUP BY ALL) u ON u.eqmt = i.eqmt AND u.from_ms = i.from_ms AND u.to_ms = i.to_ms""",
        "fuel_used_drops": _drops("plus_12h"),
        "fuel_used_drops_capped": _drops("plus_12h", " AND d < 200"),
        "fuel_used_drops_limits": _on_limited(
            "plus_12h", DROP_LIMITS, f"{_if_ok(_r6(_DROPS.format(cap=' AND d < coalesce(max_drop, 200)')))} AS fuel_used"
        ),
        "clean_drop_rise_limits": _clean_limits(" AND -d <= coalesce(max_step_drop, 200)"),
        "clean_drop_rise_limits_uncapped": _clean_limits(""),
        "shift_fuel_report_limits": window.replace(_report(60, 40), _report("coalesce(any_value(perc_no_data), 80)", "coalesce(any_value(perc_need_cab), 30)")).replace(
            "FROM (SELECT *, liters_prev - liters AS d FROM levels)",
            "FROM (SELECT *, liters_prev - liters AS d, " + ", ".join(f"{x} AS {name}" for name, x in REPORT_LIMITS.items())
            + " FROM (SELECT * REPLACE (CAST(eqmt AS INTEGER) AS eqmt) FROM levels))",
        ),
        "fuel_usage_quality_by_shift_requests": by_shift_requests,
        "fuel_used_drops_to_end_shift": _drops("end_shift_start"),
        "fuel_used_by_segment": _segments(
            f"""SELECT {_I}, {_if_ok(_r6("round(coalesce(u.used, 0), 1)"))} AS fuel_used,
  {_if_ok("coalesce(u.segments, 0)")} AS segments
FROM intervals i LEFT JOIN (SELECT eqmt, from_ms, to_ms, sum(seg_consumption) AS used, count(*) AS segments
  FROM per_seg GROUP BY ALL) u ON u.eqmt = i.eqmt AND u.from_ms = i.from_ms AND u.to_ms = i.to_ms"""
        ),
        "refuel_segments": _segments(
            f"SELECT CAST(eqmt AS VARCHAR) AS eqmt, from_ms, to_ms, CAST(seg_no AS BIGINT) AS seg_no,"
            f" {_r6('seg_consumption')} AS seg_consumption FROM per_seg"
        ),
        "clean_drop_rise": _clean("plus_12h_rollover", " AND -d <= 200"),
        "clean_drop_rise_uncapped": _clean("calendar_days_full", ""),
        "shift_fuel_report": all_shifts,
        "shift_fuel_report_stored": all_shifts,
        "shift_fuel_report_requests": requested,
        "shift_fuel_report_stored_requests": requested,
        "shift_fuel_report_window": window,
        "fuel_level_difference": level_difference,
        "fuel_used_raw_drops": _raw_drops(),
        "analyze_fuel": _analysis(),
        "fuel_between_confirmed_refills": _confirmed_refills(),
        "engine_hours": _engine_hours(literal=False),
        "engine_hours_literal": _engine_hours(literal=True),
        "idle_seconds": _with(_READINGS, _SECOND_REQUESTS, _IDLE)
        + f"SELECT q.eqmt, q.t0, q.t1, {_r6(_idle_of('q.t0', 'q.t1', 'q'))} AS idle_seconds FROM second_requests q",
        "compare_methods": compare,
        "bucket_count": _with(_READINGS, _resampled("main", 20, _seconds(MONTH)))
        + "SELECT count(*) AS buckets FROM main",
        "max_level": _readings_query(f"{_r6('max(liters)')} AS max_liters"),
        "max_level_per_equipment": _readings_query(
            f"eqmt, {_r6('max(liters)')} AS max_liters", "GROUP BY eqmt"
        ),
        "distinct_levels": _readings_query(f"DISTINCT {_r6('liters')} AS liters, eqmt"),
        "distinct_raw": _readings_query("DISTINCT raw"),
        "distinct_equipment": _readings_query("DISTINCT eqmt"),
        "day_span_of_levels": _levels_query(
            "eqmt, min(CAST(timecreated AS DATE)) AS first_day, max(CAST(timecreated AS DATE)) AS last_day",
            "GROUP BY eqmt",
        ),
        "day_span_of_readings": _readings_query(
            f"eqmt, min(CAST({at} AS DATE)) AS first_day, max(CAST({at} AS DATE)) AS last_day", "GROUP BY eqmt"
        ),
        "time_span_of_levels": _levels_query(
            "min(timecreated) AS first_time, max(timecreated) AS last_time, count(*) AS row_count"
        ),
        "reading_count": _readings_query("count(*) AS row_count"),
        "levels_between": _levels_query(_LEVEL_COLUMNS, f"WHERE {_RANGE}"),
        "levels_between_count": _levels_query("count(*) AS row_count", f"WHERE {_RANGE}"),
        "levels_between_first_10": _levels_query(
            _LEVEL_COLUMNS, f"WHERE {_RANGE} ORDER BY timecreated, levels.eqmt LIMIT 10"
        ),
        "readings_between": _readings_query(
            f"time_created, eqmt, raw, {_r6('liters')} AS liters", f"WHERE {_seconds(TEN_DAYS)}"
        ),
        "readings_between_positive": _readings_query(
            f"time_created, eqmt, raw, {_r6('liters')} AS liters",
            f"WHERE {_seconds(MONTH)} AND readings.liters > 0",
        ),
        "shift_listing_from": _shift_query(tail="WHERE CAST(shiftstart AS DATE) >= DATE '2024-01-10'"),
        "shift_listing_of": _shift_query(tail="WHERE shiftdate = DATE '2024-01-10'"),
        "shift_listing_to": _shift_query(tail="WHERE shiftdate <= DATE '2024-01-20'"),
    }
    for rule in _ENDS:
        out[f"interval_{rule}"] = _interval_query(rule, validate=rule == "next_or_last_reading")
    for rule in ("calendar_days", "calendar_days_full"):
        out[f"interval_{rule}"] = _interval_query(rule)
    for name in EDGE_QUERIES:
        out[f"edge_{name}"] = out[name].replace(_READINGS, _EDGE_READINGS)
    return out

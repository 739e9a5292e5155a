import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procweave.functions import calendars

OFFICE = [d < 5 and 9 <= h < 17 for d in range(7) for h in range(24)]
EPOCH = datetime(1970, 1, 1)


def naive_closed(slots, start, end):
    n = 0
    while start < end:
        n += not slots[start.weekday() * 24 + start.hour]
        start += timedelta(hours=1)
    return n


def naive_move(slots, t, minutes):
    while minutes > 0:
        if slots[t.weekday() * 24 + t.hour]:
            t, minutes = t + timedelta(minutes=1), minutes - 1
        else:
            t = t.replace(minute=0) + timedelta(hours=1)
    return t


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    made = {"office": OFFICE, "always": [True] * 168, "one": [k == 77 for k in range(168)]}
    made |= {f"r{k}": [rng.random() < share for _ in range(168)] for k, share in enumerate((0.1, 0.5, 0.9))}
    rows = []
    for i in range(300):
        start = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(30 * 86_400_000_000)) if i % 3 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(700))
        end = start + timedelta(microseconds=rng.randrange(-3_600_000_000, 30 * 86_400_000_000)) if i % 4 else start + timedelta(hours=rng.randrange(-1, 400))
        rows.append((i, rng.choice(sorted(made)), start, end, rng.choice([0, 1, 59, 60, 61, rng.randrange(3000)])))
    return made, rows


def test_closed_forms_against_loops(spark, cases):
    made, rows = cases
    df = spark.createDataFrame(rows, "i int, resource string, s timestamp_ntz, e timestamp_ntz, m int").join(calendars.calendar_frame(spark, made), "resource")
    got = df.select(
        "i", calendars.closed_hours(F.col("s"), F.col("e"), F.col("closed")).alias("c"), calendars.working_minutes(F.col("s"), F.col("e"), F.col("closed")).alias("w"),
        calendars.move_minutes(F.col("s"), F.col("m"), F.col("opened"), F.col("open"), F.col("open_slots")).alias("t"),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        _, name, s, e, m = rows[r["i"]]
        closed = naive_closed(made[name], s, e)
        assert r["c"] == closed
        assert r["w"] == max((e - s) / timedelta(microseconds=1) - 3_600_000_000 * closed, 0) / 6e7
        expected = naive_move(made[name], s, m)
        assert r["t"] == expected
        us = calendars.move((s - EPOCH) // timedelta(microseconds=1), m, calendars.prefixes(made[name]))
        assert us == (expected - EPOCH) // timedelta(microseconds=1)


def test_worked_answers():
    assert naive_closed(OFFICE, datetime(2024, 1, 5, 15, 30), datetime(2024, 1, 8, 10, 15)) == 64
    at = lambda *x: (datetime(*x) - EPOCH) // timedelta(microseconds=1)
    office = calendars.prefixes(OFFICE)
    assert calendars.move(at(2024, 1, 5, 16, 30, 20), 60, office) == at(2024, 1, 8, 9, 30, 20)
    assert calendars.move(at(2024, 1, 6, 10, 10, 5), 0, office) == at(2024, 1, 6, 10, 10, 5)
    assert calendars.move(at(2024, 1, 8, 16, 0), 60, office) == at(2024, 1, 8, 17, 0)


def test_a_calendar_must_open():
    with pytest.raises(ValueError):
        calendars.prefixes([False] * 168)

"""Corrections matched by issue: batch against a plain loop, stream against batch in any order; their use; life of sources."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.operators import corrections, lifecycle
from skylattice.plans.corrections import column_families
from skylattice.streaming import corrections as stream
from skylattice.streaming import lifecycle as life_stream
from skylattice.streaming import processors

BASE = 1_704_067_200.0


def made(seed=1, n=160):
    r = random.Random(seed)
    when = lambda t: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
    rows = []
    for _ in range(n):
        sat, t = r.randrange(4), float(r.randrange(0, 3000, 5))
        rows.append(r.choice([
            (sat, when(t), "orbit", BASE + t, r.randrange(3), r.randrange(2), [t] * 6, 10.0), (sat, when(t), "clock", BASE + t, r.randrange(3), None, [t, 0.0, 0.0], 5.0), (sat, when(t), "clock", BASE + t, r.randrange(3), None, [t, 0.0, 0.0], 5.0),
            (sat, when(t), "ephemeris", BASE + t, None, r.randrange(2), [t] * 19, None),
        ]))
    seen, out = set(), []
    for x in rows:  # one row for each satellite, kind, time and issue
        k = (x[0], x[2], x[3], x[4] if x[2] != "ephemeris" else x[5])
        if k not in seen:
            seen.add(k)
            out.append(x)
    return out


def plain(rows):
    out = []
    for sat, _, kind, t0, iod, _, drift, udi in rows:
        if kind != "clock":
            continue
        o = max(((x[3], x[5], x) for x in rows if x[0] == sat and x[2] == "orbit" and x[4] == iod and 0 <= t0 - x[3] <= 90), key=lambda v: v[:2], default=None)
        if not o:
            continue
        e = min(((abs(x[3] - t0), -x[3], x) for x in rows if x[0] == sat and x[2] == "ephemeris" and x[5] == o[1] and abs(x[3] - t0) <= 7200), key=lambda v: v[:2], default=None)
        if e:
            out.append((sat, t0, iod, o[1], o[0], o[2][6], o[2][7], drift, udi, e[2][6]))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matched_equals_plain(spark, seed):
    rows = made(seed)
    got = corrections.matched(spark.createDataFrame(rows + rows[:9] + [(1, None, "clock", None, 1, None, None, None)], corrections.EVENTS))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows) and len(plain(rows)) > 5
    assert corrections.matched(spark.createDataFrame([], corrections.EVENTS)).count() == 0


def test_stream_in_any_order_equals_batch(spark, tmp_path):
    """Rows shuffled over five files, so that clocks come before their orbits and ephemerides: they wait."""
    rows = made(7, 300)
    random.Random(1).shuffle(rows)
    for i in range(5):
        spark.createDataFrame(rows[i::5], corrections.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    flush = dt.datetime(2024, 1, 2)
    s = spark.readStream.schema(spark.createDataFrame([], corrections.EVENTS).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with column_families(spark):
        q = lambda: processors.run_to_table(stream.matched(s, "3600 seconds", 20.0), f"{tmp_path}/out")
        q()
        spark.createDataFrame([(99, flush, "orbit", BASE + 86400, 0, 0, [0.0] * 6, 0.0)], corrections.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = q()  # goes on from the checkpoint
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows) and len(plain(rows)) > 20


def test_stale_and_long_corrections_drop_out(spark):
    elements = [0.0 if i else BASE for i in range(19)]
    elements[1] = 26560e3
    row = lambda t0, shift, drift: (1, t0, 1, 5, t0, [shift, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0, [drift, 0.0, 0.0], 0.0, elements)
    m = spark.createDataFrame([row(BASE, 1.0, 0.5), row(BASE + 1000, 11.0, 0.5), row(BASE + 2000, 1.0, 400.0)], corrections.MATCHED)
    obs = spark.createDataFrame([(BASE + t, 1, 2.2e7) for t in (0.0, 60.0, 89.0, 95.0, 1010.0, 2010.0)] + [(BASE, 2, 2.2e7), (BASE, 1, None)], "t double, sat long, p double")
    got = {r["t"] - BASE: r for r in corrections.with_corrected_satellites(obs, m).collect()}
    assert set(got) == {0.0, 60.0, 89.0}
    assert abs((got[0.0]["sx"] ** 2 + got[0.0]["sy"] ** 2 + got[0.0]["sz"] ** 2) ** 0.5 - (26560e3 - 1.0)) < 1e-3 and abs(got[60.0]["sclock"] - 0.5) < 1e-6


def log(seed=1, n=400):
    r = random.Random(seed)
    rows = [(r.randrange(5), r.randrange(0, 40 * 86_400_000, 1000), r.choices(["add", "data", "delete", "other"], [2, 6, 1, 1])[0]) for _ in range(n)]
    return rows + rows[:20] + [(9, 1000, "data"), (9, 2000, "delete")]


def life(rows, until=None):
    """One name after another, one thing after another."""
    out, limit = [], until if until is not None else 1 << 62
    order = {"add": 0, "data": 1, "delete": 2}
    for name in sorted({r[0] for r in rows}):
        last, tried, quiet = None, 0, False
        todo = sorted({(at, order[k]) for n, at, k in rows if n == name and k in order})
        for at, turn in [*todo, (limit + 1, None)]:
            if turn == 0 and last is not None:
                continue
            if last is not None:
                if last + lifecycle.QUIET < at and last + lifecycle.QUIET <= limit:
                    out.append((name, last + lifecycle.QUIET, "silent", 0))
                    quiet, pause, t = True, lifecycle.PAUSE, last + lifecycle.QUIET
                    for k in range(lifecycle.TRIES):
                        t += pause
                        pause = min(2 * pause, lifecycle.LONGEST)
                        if t < at:
                            out.append((name, t, "retry", k + 1))
                            tried = k + 1
            if turn == 0 and last is None:
                out.append((name, at, "added", 0))
                last = at
            elif turn == 1 and last is not None:
                if quiet:
                    out.append((name, at, "up", tried))
                last = at
            elif turn == 2 and last is not None:
                out.append((name, at, "deleted", tried))
                last = None
            tried, quiet = 0, False
    return sorted(out)


def test_life_equals_plain(spark):
    rows = log()
    x = spark.createDataFrame([*rows, (None, 1, "add"), (1, None, "add")], "name long, at long, kind string")
    got = sorted(map(tuple, lifecycle.states(x).collect()))
    assert got == life(rows) and {r[2] for r in got} == {"added", "silent", "retry", "up", "deleted"}
    until = 20 * 86_400_000
    early = [r for r in rows if r[1] <= until]
    assert sorted(map(tuple, lifecycle.states(x.filter(F.col("at") <= until), until).collect())) == life(early, until)
    assert lifecycle.states(x.limit(0)).count() == 0


def test_life_of_a_stream_equals_batch(spark, tmp_path):
    """Rows in six files, each shuffled within a day; what lies past the last watermark comes when time goes on, from the checkpoint."""
    rows = log(5)
    r = random.Random(2)
    rows.sort(key=lambda x: x[1] + r.randrange(86_400_000))
    schema = "name long, at long, kind string"
    for i in range(6):
        spark.createDataFrame(rows[i * len(rows) // 6 : (i + 1) * len(rows) // 6], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    end = 400 * 86_400_000
    with column_families(spark):
        q = lambda: processors.run_to_table(life_stream.states(s, "2 days"), f"{tmp_path}/out")
        first = q().count()
        spark.createDataFrame([(77, end, "data")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = q()
    assert sorted(map(tuple, got.collect())) == life(rows) and 0 < first < got.count()


class Counted:
    """A list state, or the handle that gives it, which counts the calls that go to the state store."""

    def __init__(self):
        self.calls, self.rows, self.lists, self.timers = 0, [], {}, []

    def getListState(self, name, schema):  # noqa: N802
        return self.lists.setdefault(name, Counted())

    getMapState = getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def appendValue(self, row):  # noqa: N802
        self.appendList([row])

    def updateValue(self, key, value):  # noqa: N802
        self.appendList([(*key, *value)])

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_batch_of_corrections_is_one_call_for_each_list(spark):
    """However many rows a satellite has in a batch; one timer decides all clock rows that are due, and what is too old goes."""
    kinds = ["ephemeris", "orbit", "clock"]
    pdf = pd.DataFrame([{"kind": kinds[i % 3], "t0": float(i), "iod": 1, "iode": 4, "numbers": [float(i)], "udi": 0.0} for i in range(300)])
    m, handle = stream.Matcher(10.0), Counted()
    m.init(handle)
    list(m.handleInputRows((5,), iter([pdf, pdf]), At(0)))  # all rows come twice
    assert [s.calls for s in handle.lists.values()] == [1, 1, 1] and handle.timers == [12_000]
    got = pd.concat(m.handleExpiredTimer((5,), At(200_000), None))
    assert list(got["t0"]) == [float(t) for t in range(2, 191, 3)]
    assert list(got["orbit_t0"]) == [t - 1 for t in got["t0"]] and [n[0] for n in got["elements"]] == [t + 1 for t in got["t0"]]
    left = {k: len(s.rows) for k, s in handle.lists.items()}
    assert left == {"ephemerides": 100, "orbits": 67, "clocks": 37} and handle.timers[1:] == [201_000]
    assert [s.calls for s in handle.lists.values()] == [2, 2, 2]
    assert list(m.handleExpiredTimer((5,), At(200_000), None)) == []


def test_a_batch_of_a_log_is_one_call(spark):
    s, handle = life_stream.Life(), Counted()
    s.init(handle)
    pdf = pd.DataFrame({"at": [30, 10, 20, 0], "kind": ["data", "add", "other", "data"]})
    assert list(s.handleInputRows((1,), iter([pdf, pdf]), At(0))) == []
    assert handle.lists["waiting"].calls == 1 and len(handle.lists["waiting"].rows) == 6 and handle.timers == [0]


def test_points_go_through_arrow_groups(spark):
    """A source with too few satellites has no row; groups are Arrow tables, and columns that the filter doesn't take stay out of them."""
    x = spark.range(3).select(F.lit(1).cast("long").alias("srcid"), F.lit(0.0).alias("t"), F.col("id").alias("sat"), F.lit("other").alias("other"), F.lit(False).alias("slip"), *[F.lit(2.2e7).alias(c) for c in ("code", "phase", "sx", "sy", "sz", "sclock")], *[F.lit(3.7e6).alias(c) for c in ("x0", "y0", "z0")])
    got = corrections.precise_points(x)
    assert got.collect() == [] and got.columns == ["srcid", "t", "x", "y", "z", "n"]
    text = got._jdf.queryExecution().analyzed().toString()
    assert "InArrow" in text and "InPandas" not in text
